"""Fill-in-the-middle rearrangement of texts, cut where a unit pattern matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.scratch import without_names

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four whole numbers under 2**32 that follow from the seed and the id written as text (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_points(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """The number n of units, and where the unit of the lesser and of the greater of first % (n + 1) and second %
    (n + 1) ends. Two passes of the matcher: one counts, one is advanced to both ranks and no further; no unit is
    kept."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches, at, ends = unit.finditer(text), 0, []
    end = 0
    for rank in (low, high):
        if rank > at:
            end = next(islice(matches, rank - at - 1, None)).end()
            at = rank
        ends.append(end)
    return n, ends[0], ends[1]


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Texts can be rebuilt only if no sentinel can begin inside another one."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (i != j and a in b):
                raise ValueError("sentinels must be different texts that don't overlap")


def rearrange(docs: DataFrame, unit: str = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to docs (doc_id, text, ...): the text as prefix, suffix
    and middle in the order of its form, each behind its sentinel. `rate` of 100 texts are rearranged, `spm_rate`
    of 100 of these with the suffix first; units are the matches of `unit`, which must cover the text. The row's
    own draws decide, so that any run gives the same.

    A null text counts as an empty one; empty texts and those that hold a sentinel stay plain, with null lengths.
    Texts of any length are matched whole, in memory of the text's own size. Rows stand for themselves: repeated
    rows come out alike, rows without an id draw as if it were empty. An empty table gives an empty one; columns
    named like the new ones are replaced."""
    _checked(sentinels)
    p, s, m = sentinels

    @F.pandas_udf(_SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(unit)
        for batch in batches:
            rows = []
            for text, h1, h2, h3, h4 in zip(*batch, strict=True):
                n, low, high = cut_points(text, pattern, h1, h2)
                if not text or any(x in text for x in sentinels) or h3 % 100 >= rate:
                    rows.append((n, "plain", None, None, text))
                    continue
                prefix, middle, suffix = text[:low], text[low:high], text[high:]
                spm = h4 % 100 < spm_rate
                output = "".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
                rows.append((n, "spm" if spm else "psm", low, high - low, output))
            yield pd.DataFrame(rows, columns=NEW).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    kept = without_names(docs.columns, NEW)
    made = docs.withColumn("__sg_fim", run(F.coalesce("text", F.lit("")), *draws("doc_id", seed)))
    return made.select(*kept, *[F.col(f"__sg_fim.{c}").alias(c) for c in NEW])


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a row of output and form was made from. A sentinel can't span a border between a piece and
    the next sentinel, so that splitting at sentinels gives the pieces back."""
    pieces = F.split(F.col(output), "|".join(re.escape(x) for x in sentinels), -1)
    psm = F.concat(pieces[1], pieces[3], pieces[2])
    spm = F.concat(pieces[2], pieces[3], pieces[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
