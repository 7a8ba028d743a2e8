"""HTML as a stream of text and tags, in one pass.

Tags end where the HTML standard says: quotes count after an equals sign only, and a tag, comment,
quoted value or script that is never closed runs to the end of the page. So every character is
consumed once (patterns are possessive: they never go back), and time is linear in a page's length
whatever stands in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

BLANK = r"[ \t\n\f\r]"
TAG = re.compile(
    rf"""<(?:
      !--(?:-?>|.*?(?:--!?>|\Z))                       # comment
    | [!?][^>]*+(?:>|\Z)                               # declaration
    | /(?![a-zA-Z])[^>]*+(?:>|\Z)                      # an end tag without a name
    | (/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[^>=]++|={BLANK}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)
    )""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(rf"""([^ \t\n\f\r/>=][^ \t\n\f\r/>=]*+)(?:{BLANK}*+={BLANK}*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>]*+)))?+""")
#: Elements whose content is no markup; none of it is text of the page.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])[^>]*+(?:>|\Z)", re.I | re.A) for t in RAW}


def decoded(text: str) -> str:
    """Character references as characters."""
    return html.unescape(text) if "&" in text else text


def attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), decoded(m[2] or m[3] or m[4] or ""))
    return out


def scan(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, tag, whether it ends the element, source of its attributes) of each tag, and at the end the rest with an empty tag.

    Texts are decoded piece by piece. The content of raw elements is left out; their end follows their start.
    """
    at, search = 0, TAG.search
    while m := search(page, at):
        text = decoded(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if text:
                yield text, "", False, ""
            continue
        tag = m[2].lower()
        yield text, tag, bool(m[1]), m[3]
        if tag in RAW_END and not m[1]:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            yield "", tag, True, ""
    yield decoded(page[at:]), "", False, ""


def plain_text(page: str) -> tuple[str, str | None]:
    """All text of a page with a space for each tag, and the language its html element declares."""
    parts, language = [], None
    for text, tag, ends, source in scan(page):
        parts.append(text)
        if tag == "html" and not ends and language is None:
            found = re.match(r"\s*+([a-zA-Z]{2,3})(?![a-zA-Z])", attributes(source).get("lang", ""))
            language = found[1].lower() if found else None
    return " ".join(parts), language


def links(page: str) -> list[str]:
    """The href of each a element."""
    found = (attributes(source).get("href") for _, tag, ends, source in scan(page) if tag == "a" and not ends and "=" in source)
    return [x.strip() for x in found if x]
