"""Word lists and tables that results depend on."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Stop words removed by the policies stop and completo (English, then Spanish, without accents).
STOPWORDS = frozenset(
    """
    a about above after again against all am an and any are as at be because been before being below between both
    but by can could did do does doing down during each few for from further had has have having he her here hers
    herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on
    once only or other our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which
    while who whom why will with would you your yours yourself yourselves also may s t
    al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos
    en entre era eran es esa esas ese eso esos esta estaba estado estan este esto estos fue fueron ha habia han hasta
    hay la las le les lo los mas mi mis mucho muy nada ni nos nosotros o os otra otras otro otros para pero poco
    por porque que quien se sea ser si sin sido sobre son su sus tambien te tiene tienen todo todos tu tus un una
    uno unos y ya yo
    """.split()
)

# Words left out of the corpus report's list of frequent words.
REPORT_STOPWORDS = frozenset(
    """
    a al algo algunas algunos ante aquel aquella aquellas aquello aquellos aqui arriba atras bajo bien cada como con
    contra cual cuando de del desde donde dos e el ella ellas ellos en entre era eramos eran eras es esa esas ese eso
    esos esta estaba estaban estamos estan este esto estos fin fue fuera fueron fui ha habia habian hace hacia han
    hasta hay he hemos hoy hubo la las le lo los mas me mi mis mucho muy nada ni no nos nosotros nunca o os otro para
    pero poco por porque que quien se ser si sin sobre so solamente solo somos son soy su sus tambien te ti tiene
    tienen todo tu tus u un una uno usted ustedes y ya yo
    the a an and are as at be been being but by could did do does doing for from had has have having he her here hers
    herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only
    or other our ours ourselves out over own same she should so some such than that their theirs them themselves then
    there these they this those through to too under until up very was we were what when where which while who whom
    why with would you your yours yourself yourselves
    """.split()
)
REPORT_MIN_LENGTH = 3

# Words by which a page's language is told, and the least share of them.
ENGLISH = "the be to of and a in that have i it for not on with he as you do at this but his by from".split()
SPANISH = "de la que el en y a los del se las por un para con no una su al lo como mas más pero sus le es o este esta esto".split()
LANGUAGE_SHARE, LANGUAGE_WORDS, LANGUAGE_CHARS, LANGUAGE_LEAST = 0.04, 2000, 20000, 20

# Month names and their numbers.
MONTHS = {
    1: "january jan enero ene",
    2: "february feb febrero",
    3: "march mar marzo",
    4: "april apr abril abr",
    5: "may mayo",
    6: "june jun junio",
    7: "july jul julio",
    8: "august aug agosto ago",
    9: "september sept sep septiembre setiembre set",
    10: "october oct octubre",
    11: "november nov noviembre",
    12: "december dec diciembre dic",
}

# Names of several words and what they become, in order of definition.
NAMES = """
the legend of zelda => zelda
legend of zelda => zelda
breath of the wild => zeldabotw
tears of the kingdom => zeldatotk
super mario bros => supermariobro
super mario => supermario
mario kart => mariokart
super smash bros => smashbro
smash bros => smashbro
grand theft auto => gta
call of duty => cod
elden ring => eldenring
dark souls => darksouls
final fantasy => finalfantasy
final fantasy xiv => ffxiv
world of warcraft => wow
league of legends => lol
counter strike => counterstrike
red dead redemption => rdr
hollow knight => hollowknight
stardew valley => stardewvalley
baldur s gate => baldursgate
baldurs gate => baldursgate
animal crossing => animalcrossing
fire emblem => fireemblem
dead cells => deadcells
risk of rain => riskofrain
slay the spire => slaythespire
oxygen not included => oxygennotincluded
don t starve => dontstarve
dont starve => dontstarve
guild wars => guildwars
old school runescape => osrs
the elder scrolls => elderscrolls
elder scrolls => elderscrolls
metal gear solid => metalgearsolid
resident evil => residentevil
street fighter => streetfighter
mortal kombat => mortalkombat
half life => halflife
nintendo switch => nintendoswitch
playstation 5 => ps5
playstation 4 => ps4
xbox series x => xboxseriesx
xbox one => xboxone
game boy => gameboy
steam deck => steamdeck
epic games => epicgames
electronic arts => ea
square enix => squareenix
"""

# Synonyms and the term they are brought to, in order of definition.
THESAURUS = """
videogames => videogame
videojuego => videogame
videojuegos => videogame
video game => videogame
video games => videogame
juego => game
juegos => game
jugador => player
jugadores => player
gamer => player
gamers => player
consola => console
consolas => console
lanzamiento => release
fecha de lanzamiento => release
desarrollador => developer
desarrolladora => developer
desarrolladores => developer
dev => developer
devs => developer
editora => publisher
distribuidora => publisher
multijugador => multiplayer
multi player => multiplayer
co op => coop
cooperativo => coop
cooperative => coop
single player => singleplayer
un jugador => singleplayer
jefe => boss
jefes => boss
nivel => level
niveles => level
personaje => character
personajes => character
arma => weapon
armas => weapon
mision => quest
misiones => quest
mission => quest
missions => quest
logro => achievement
logros => achievement
trophy => achievement
trophies => achievement
trofeo => achievement
trofeos => achievement
role playing game => rpg
role playing => rpg
rol => rpg
first person shooter => fps
shooter en primera persona => fps
mmo => mmorpg
computadora => pc
ordenador => pc
psx => playstation
reviews => review
analisis => review
resena => review
resenas => review
walkthrough => guide
guia => guide
guias => guide
mago => mage
magos => mage
hechicero => sorcerer
hechiceros => sorcerer
receta => recipe
recetas => recipe
pocion => potion
pociones => potion
velocidad => speed
swiftness => speed
ubicacion => location
ubicaciones => location
donde encontrar => location
amuleto => charm
amuletos => charm
requisitos => requirements
requisitos minimos => minimum requirements
precio => price
precios => price
gratis => free
linea temporal => timeline
cronologia => timeline
espada => sword
espadas => sword
armadura => armor
vendidos => sold
ventas => sales
"""


def rules(text: str) -> list[tuple[str, str]]:
    """Rules written as ``left => right``, one a line."""
    pairs = (r.split("=>") for r in text.splitlines() if "=>" in r)
    return [(a.strip(), b.strip()) for a, b in pairs]


# Letters that do not decompose into ASCII letters and marks, and what they fold to.
PLAIN_LETTERS = {"Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Ð": "D", "ð": "d", "Đ": "D", "đ": "d", "Þ": "TH", "þ": "th", "Ł": "L", "ł": "l", "Ŀ": "L", "ŀ": "l", "ı": "i"}
#: Blocks whose letters fold: Latin-1, Latin Extended A and B, Latin Extended Additional.
FOLDED_BLOCKS = ((0xC0, 0x24F), (0x1E00, 0x1EFF))


@lru_cache(1)
def folding() -> dict[str, str]:
    """Letter to ASCII letters: what compatibility decomposition leaves without its marks, if that is letters."""
    out = {}
    for low, high in FOLDED_BLOCKS:
        for c in map(chr, range(low, high + 1)):
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if bare != c and bare.isascii() and bare.isalpha():
                out[c] = bare
    return out | PLAIN_LETTERS


# Words that make a page or link one about the subject, by default.
TOPIC_WORDS = "game games gaming gameplay gamer gamers videogame videogames video_game video-game juego juegos videojuego videojuegos jugabilidad consola consolas console consoles nintendo playstation xbox sega steam esports multiplayer multijugador rpg arcade speedrun dlc".split()
TOPIC_LEAST_HITS, TOPIC_LEAST_DENSITY = 5, 3.0

# URLs that are never fetched.
DENIED_EXTENSIONS = "jpg jpeg png gif webp svg ico bmp tif pdf zip rar 7z gz tar exe dmg apk mp3 mp4 m4a ogg wav webm avi mov mkv flv css js json xml rss woff woff2 ttf eot".split()
DENIED_QUERY_KEYS = "action oldid diff curid printable veaction redlink returnto search".split()
NAMESPACES = "Special Especial User Usuario User_talk Usuario_discusión Talk Discusión File Archivo Image Template Plantilla Template_talk Help Ayuda MediaWiki Module Módulo Wikipedia Project Draft Thread Board Message_Wall Forum".split()
MORE_NAMESPACES = ["usuario_discusi%c3%b3n:", "discusi%c3%b3n:", "m%c3%b3dulo:"]
JUNK_PATHS = "/login /signin /signup /register /account /cart /checkout /search /feed /wp-json /cdn-cgi/ /amp/".split()
TRACKING_PARAMS = ("fbclid", "gclid")

# Elements left out of a page's text, names of page furniture, and elements that end a line.
STRIPPED_TAGS = frozenset("script style noscript template svg iframe form nav footer header aside".split())
FURNITURE = frozenset("toc navbox mw-editsection reference reflist printfooter catlinks mw-jump-link mw-indicators siteNotice mw-navigation footer-info footer-places footer-icons sidebar navigation nav-menu breadcrumb breadcrumbs cookie-banner cookie-notice vector-toc mw-references-wrap references navbox-styles mw-cite-backlink noprint metadata".split())
LINE_TAGS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 dd dt dl blockquote pre table section figure figcaption hr".split())
