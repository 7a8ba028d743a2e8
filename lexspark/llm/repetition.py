"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths in numpy measure the characters that lie
inside n-grams and lines which a text repeats. One pass over the rows, no shuffle:
a hot source or a group of copies changes nothing.

Defined results: a null text counts as empty; an empty text has no words and fails
the base rule; rows are judged one by one, so repeated rows give repeated results;
columns other than ``doc_id`` and ``text`` are not read; an empty table gives an
empty result; a text of any length is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspark.llm.words import DocBatch, later, map_texts, repeated, within

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of a text that is kept.

    ``gram_limits``: for each n-gram length, the share of word characters inside
    n-grams that the text holds twice or more; ``line_limit``: the share of word
    characters in lines equal to an earlier one.
    """

    min_words: int = 10
    repeat_percent: int = 20
    gram_limits: dict[int, float] = field(default_factory=lambda: {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15})
    line_limit: float = 0.20


def measure(batch: DocBatch, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts, coverage shares and verdicts of some texts."""
    letters = batch.in_word & ((batch.data & 0xC0) != 0x80)
    word_chars = batch.sums(letters)
    chars_before = np.concatenate([np.zeros(1, np.int64), np.cumsum(letters, dtype=np.int64)])
    starts, ends = batch.spans
    word_len = chars_before[ends] - chars_before[starts]
    n_words = batch.n_words

    at, grams = batch.grams(5)
    twice = repeated(within(grams, batch.doc_of_word[at]))
    covered = batch.covered(at[twice], 5)
    n_repeat = batch.word_sums(covered)

    doc, a, b, words = batch.lines
    full = np.flatnonzero(words > 0)
    again = later(within(batch.hash_spans(a[full], b[full]), doc[full]))
    n_dup_lines = np.bincount(doc[full][again], minlength=batch.n_docs).astype(np.int64)
    dup_chars = np.bincount(doc[full][again], weights=(chars_before[b[full]] - chars_before[a[full]])[again], minlength=batch.n_docs)

    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    share = np.maximum(word_chars, 1)
    line_share = dup_chars / share
    kept = ~base_failed & (line_share <= rules.line_limit)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": batch.sums(SYMBOLS[batch.data]), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": base_failed, "dup_line_share": line_share}
    some = n_repeat > 0
    for n, limit in sorted(rules.gram_limits.items()):
        if n == 5:
            inside = covered
        else:  # a repeated longer n-gram holds repeated 5-grams: other texts have none
            at, grams = batch.grams(n)
            if n > 5:
                near = some[batch.doc_of_word[at]]
                at, grams = at[near], grams[near]
            inside = batch.covered(at[repeated(within(grams, batch.doc_of_word[at]))], n)
        out[f"dup_{n}gram_share"] = batch.word_sums(word_len * inside) / share
        kept &= out[f"dup_{n}gram_share"] <= limit
    return out | {"kept": kept}


def repetition_rules(df: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """Per row of df (doc_id, text): counts, coverage shares and ``kept``."""
    rules = rules or RepetitionRules()
    shares = ["dup_line_share", *(f"dup_{n}gram_share" for n in sorted(rules.gram_limits))]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in shares)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(DocBatch.of(part.column("text")), rules)
        names = [*counts, "base_failed", "kept", *shares]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[c]) for c in names)], ["doc_id", *names])

    return map_texts(df.select("doc_id", "text"), one, schema)
