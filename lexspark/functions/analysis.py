"""Text to index terms under a policy, as column expressions.

Stages, in this order: dates, numbers, lower case, tokens, folding, length, names and
thesaurus, stop words, stems. All but stems are built-in expressions; stems are a
vectorised function with a dictionary of the words it has seen.
"""

from __future__ import annotations

import configparser
import json
from dataclasses import asdict, dataclass, fields
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexspark.functions import tables
from lexspark.functions.porter import stem

TOKEN = r"([\p{L}\p{N}]+)"


@dataclass(frozen=True)
class Policy:
    """Which stages an index applies."""

    name: str = "basico"
    fold: bool = True
    lower: bool = True
    dates: bool = False
    numbers: bool = False
    stopwords: bool = False
    thesaurus: bool = False
    names: bool = False
    stems: bool = False
    min_length: int = 1
    max_length: int = 40

    def flags(self) -> int:
        """The stages as bits, in the order of the fields."""
        stages = (self.fold, self.lower, self.dates, self.numbers, self.stopwords, self.thesaurus, self.names, self.stems)
        return sum(1 << i for i, on in enumerate(stages) if on)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Policy:
        known = {f.name for f in fields(Policy)}
        return Policy(**{k: v for k, v in json.loads(text).items() if k in known})

    @staticmethod
    def from_ini(text: str) -> Policy:
        """A policy from the ``[normalizacion]`` section of an INI file; a stage's file given as ``no`` turns it off."""
        parser = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), interpolation=None)
        parser.read_string(text)
        part = dict(parser["normalizacion"]) if parser.has_section("normalizacion") else {}
        on = lambda k: part.get(k, "no").strip().lower() in ("si", "sí", "yes", "true", "1", "on")
        given = lambda k: part.get(k, "no").strip().lower() not in ("", "no")
        return Policy(
            name=parser.get("indice", "nombre", fallback="basico"),
            fold=given("plegado"),
            lower=on("minusculas"),
            dates=on("fechas"),
            numbers=on("numeros"),
            stopwords=given("stopwords"),
            thesaurus=given("tesauro"),
            names=given("nombres"),
            stems=part.get("stemming", "no").strip().lower() == "porter",
            min_length=int(part.get("largo_min", 1)),
            max_length=int(part.get("largo_max", 40)),
        )


BASIC = Policy()
STOP = Policy("stop", dates=True, numbers=True, stopwords=True)
FULL = Policy("completo", dates=True, numbers=True, stopwords=True, thesaurus=True, names=True, stems=True)
POLICIES = {p.name: p for p in (BASIC, STOP, FULL)}

YEAR = r"([12][0-9]{3})"
#: (pattern of a number's digits, what goes before them): one digit needs a zero.
MONTH = ((r"([1-9])", "0"), (r"(0[1-9]|1[0-2])", ""))
DAY = ((r"([1-9])", "0"), (r"(0[1-9]|[12][0-9]|3[01])", ""))


@lru_cache(1)
def date_steps() -> tuple[tuple[str, str], ...]:
    """Patterns and replacements that bring the valid dates of four formats to YYYYMMDD, in order.

    Each number takes a pattern for one digit and one for two, so that the replacement can
    pad it and no step ever touches an impossible date.
    """
    steps = []
    for m, mz in MONTH:
        for d, dz in DAY:
            steps.append((rf"(?U)\b{YEAR}[-/.]{m}[-/.]{d}\b", f"$1{mz}$2{dz}$3"))
    names = {number: "|".join(sorted(words.split(), key=lambda w: (-len(w), w))) for number, words in tables.MONTHS.items()}
    for number, words in names.items():
        for d, dz in DAY:
            steps.append((rf"(?U)\b(?i:{words})\.?\s+{d}(?:st|nd|rd|th)?,?\s+{YEAR}\b", f"$2{number:02d}{dz}$1"))
    for number, words in names.items():
        for d, dz in DAY:
            steps.append((rf"(?Ui)\b{d}(?:st|nd|rd|th)?\s+(?:de\s+)?(?:{words})\.?,?\s+(?:del?\s+)?{YEAR}\b", f"$2{number:02d}{dz}$1"))
    for m, mz in MONTH:
        for d, dz in DAY:
            steps.append((rf"(?U)\b{m}[/.-]{d}[/.-]{YEAR}\b", f"$3{mz}$1{dz}$2"))
    for m, mz in MONTH:
        steps.append((rf"(?U)\b(1[3-9]|2[0-9]|3[01])[/.-]{m}[/.-]{YEAR}\b", f"$3{mz}$2$1"))
    return tuple(steps)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_dates(text: Column) -> Column:
    """Dates as YYYYMMDD; a text without four digits in a row is left alone before any pattern runs."""
    out = text
    for pattern, replacement in date_steps():
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(text.rlike("[0-9]{4}"), out).otherwise(text)


def normalize_numbers(text: Column) -> Column:
    """1,000,000 as 1000000 and 21st as 21."""
    joined = F.when(F.contains(text, F.lit(",")), F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")).otherwise(text)
    return F.regexp_replace(joined, r"(?Ui)\b([0-9]+)(?:st|nd|rd|th)\b", "$1")


def fold(token: Column) -> Column:
    """Letters with marks and ligatures as ASCII letters; ASCII tokens pass by."""
    single = {k: v for k, v in tables.folding().items() if len(v) == 1}
    several = {k: v for k, v in tables.folding().items() if len(v) > 1}
    out = F.translate(token, "".join(single), "".join(single.values()))
    for k, v in several.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(F.octet_length(token) == F.length(token), token).otherwise(out)


def tokens(text: Column, policy: Policy = BASIC) -> Column:
    """Runs of letters and digits, lower-cased and folded as the policy says."""
    return raw_tokens(text, policy, policy.fold)


def raw_tokens(text: Column, policy: Policy = BASIC, folded: bool = False) -> Column:
    """Tokens before folding, unless asked for: letters fold to letters, so no token's ends move."""
    text = F.coalesce(text, F.lit(""))
    if policy.dates:
        text = let(text, normalize_dates)
    if policy.numbers:
        text = let(text, normalize_numbers)
    if policy.lower:
        text = F.lower(text)
    if folded:
        text = let(text, fold)
        if policy.lower:
            text = F.lower(text)
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def _plain_tokens(text: str) -> list[str]:
    """tokens() of a rule's side, on the driver."""
    folded = "".join(tables.folding().get(c, c) for c in text.lower()).lower()
    out, word = [], ""
    for c in folded + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


@lru_cache(8)
def phrase_rules(policy: Policy) -> dict[str, tuple[str, ...]]:
    """Phrase (joined by spaces) to what replaces it; names come before the thesaurus, and the first definition stays."""
    out: dict[str, tuple[str, ...]] = {}
    for on, text in ((policy.names, tables.NAMES), (policy.thesaurus, tables.THESAURUS)):
        for left, right in tables.rules(text) if on else ():
            a, b = _plain_tokens(left), _plain_tokens(right)
            if a and b:
                out.setdefault(" ".join(a), tuple(b))
    return out


def replace_phrases(array: Column, policy: Policy) -> Column:
    """The longest phrase that begins at each token, left to right; what it became is not looked at again."""
    found = phrase_rules(policy)
    longest = max(len(k.split()) for k in found)
    listed = [x for k, v in found.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    table = F.create_map(*listed)  # of literals: folded once
    heads = F.array(*map(F.lit, sorted({k.split()[0] for k in found})))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(acc: Column, i: Column) -> Column:
        hit, width = F.lit(None).cast("array<string>"), F.lit(1)
        for n in range(1, longest + 1):  # the widest that fits stays
            phrase = table[F.array_join(F.slice(array, i, n), " ")]
            fits = phrase.isNotNull() & (F.size(array) - i + 1 >= n)
            width = F.when(fits, n).otherwise(width)
            hit = F.when(fits, phrase).otherwise(hit)
        skipping = acc["skip"] > 0
        out = F.when(skipping, acc["out"]).otherwise(F.concat(acc["out"], F.coalesce(hit, F.array(F.get(array, i - 1)))))
        return F.struct(out.alias("out"), F.when(skipping, acc["skip"] - 1).otherwise(width - 1).alias("skip"))

    places = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array))).otherwise(F.array().cast("array<int>"))
    return F.when(F.arrays_overlap(array, heads), F.aggregate(places, zero, step, lambda acc: acc["out"])).otherwise(array)


_stems: dict[str, str] = {}


def stem_cached(word: str) -> str:
    found = _stems.get(word)
    if found is None:
        if len(_stems) > 1_000_000:
            _stems.clear()
        found = _stems[word] = stem(word)
    return found


@lru_cache(8)
def finisher(policy: Policy):
    """The stages from phrases on, for one list of tokens."""
    table = {tuple(k.split()): v for k, v in phrase_rules(policy).items()}
    heads: dict[str, list[tuple[str, ...]]] = {}
    for phrase in sorted(table, key=len, reverse=True):
        heads.setdefault(phrase[0], []).append(phrase)
    stop = tables.STOPWORDS if policy.stopwords else frozenset()

    def one(words: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(words):
            hit = next((p for p in heads.get(words[i], ()) if tuple(words[i : i + len(p)]) == p), None)
            out.extend(table[hit] if hit else (words[i],))
            i += len(hit) if hit else 1
        return [stem_cached(w) if policy.stems else w for w in out if w not in stop]

    return one


@lru_cache(8)
def finished_arrays(policy: Policy):
    """finisher() as a vectorised function over arrays of tokens: a policy with stems needs Python anyway."""
    one = finisher(policy)

    @F.pandas_udf(ArrayType(StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else one(list(a)))

    return run


@lru_cache(8)
def term_counter(policy: Policy):
    """A function from lists of raw tokens (Arrow) to (row, term, times) of each row's terms.

    Words are folded, measured and finished once a batch, by their codes; only rows that hold the head of a phrase are walked.
    """
    one = finisher(policy)
    letters = str.maketrans(tables.folding()) if policy.fold else {}
    heads = {k.split()[0] for k in phrase_rules(policy)}

    def count(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), lengths)
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = [w if w.isascii() else w.translate(letters).lower() if policy.lower else w.translate(letters) for w in words]
        fits = [policy.min_length <= len(w) <= policy.max_length for w in words]
        final: dict[str, int] = {}
        number = np.array([final.setdefault(t[0], len(final)) if ok and w not in heads and (t := one([w])) else -1 for w, ok in zip(words, fits, strict=True)], np.int64)
        if heads:
            walked = np.unique(row[np.isin(code, [i for i, w in enumerate(words) if w in heads])])
            ends = np.cumsum(lengths)
            found = [(r, [final.setdefault(t, len(final)) for t in one([words[c] for c in code[ends[r] - lengths[r] : ends[r]] if fits[c]])]) for r in walked]
            plain = ~np.isin(row, walked)
            row = np.concatenate([row[plain], *(np.full(len(t), r) for r, t in found)])
            number = np.concatenate([number[code[plain]], *(np.array(t, np.int64) for _, t in found)])
        else:
            number = number[code]
        good = number >= 0
        key, times = np.unique(row[good] * max(len(final), 1) + number[good], return_counts=True)
        terms = pa.array(list(final), pa.string())
        return pa.array(key // max(len(final), 1)), terms.take(pa.array(key % max(len(final), 1))), pa.array(times, pa.int64())

    return count


def analyze(text: Column, policy: Policy = BASIC) -> Column:
    """Index terms of a text, in order. A null text has none. Without stems, all of it is built-in expressions."""
    out = F.filter(tokens(text, policy), lambda t: F.length(t).between(policy.min_length, policy.max_length))
    if policy.stems:
        return finished_arrays(policy)(out)
    if phrase_rules(policy):
        out = let(out, lambda array: replace_phrases(array, policy))
    if policy.stopwords:
        out = F.filter(out, lambda t: ~t.isin(*sorted(tables.STOPWORDS)))
    return out
