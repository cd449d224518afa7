"""Quality rules: base rules and compression bands.

A text's whole UTF-8 form and each of its fixed chunks are compressed with zstandard; the ratio is compressed bytes
over bytes. Repetitive text compresses too well and random text too little, and what is usual depends on the length,
because a compressor needs some text before it finds anything to share. So each length class has its own band, a
table of documented limits. A text is rejected if its whole ratio leaves the band of its class, or if more than
``bad_share`` of its chunks leave the band of a chunk. Chunks have one size, so one band fits them: a text's last chunk are its
last bytes, which may overlap the chunk before, so that every byte is judged; a text of one chunk or less has only its whole ratio.

Defined cases: a null text is the empty text; it has no words and fails the base rules, as does a text of white space alone.
Repeated rows are judged each; an empty table gives an empty result; very long texts take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import words

CHUNK = 2048
#: (bytes up to, least ratio, greatest ratio) for whole texts; shorter texts share less, so their limits are higher.
BANDS = ((256, 0.3, 1.6), (512, 0.28, 0.8), (1024, 0.27, 0.74), (2048, 0.25, 0.67), (4096, 0.22, 0.62), (16384, 0.2, 0.58), (1 << 62, 0.18, 0.55))
CHUNK_BAND = (0.25, 0.68)
BAD_SHARE = 0.25

OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"


def repeated_words(w: list[bytes]) -> int:
    """Words that lie in some 3-word window found twice or more."""
    grams = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    n, hit, until = Counter(grams), 0, 0
    for i in compress(range(len(grams)), (n[g] > 1 for g in grams)):
        hit += i + 3 - max(i, until)
        until = i + 3
    return hit


def judge(text: str | None, ratio, chunk: int = CHUNK, bands=BANDS, chunk_band=CHUNK_BAND, bad_share: float = BAD_SHARE) -> tuple:
    """The columns of OUT for one text; ratio: a function from bytes to compressed bytes over bytes."""
    text = text or ""
    raw, w = text.encode(), words(text)
    spaces = len(re.findall(r"[\x20\x09-\x0D]", text))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    again = repeated_words(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(w) < 50 or 100 * again > 50 * len(w)
    whole = ratio(raw) if raw else 0.0
    low, high = next((a, b) for size, a, b in bands if len(raw) <= size)
    starts = [*range(0, len(raw) - chunk, chunk), len(raw) - chunk] if len(raw) > chunk else []
    chunks = [raw[i : i + chunk] for i in starts]
    bad = sum(not chunk_band[0] <= ratio(c) <= chunk_band[1] for c in chunks)
    kept = not failed and low <= whole <= high and bad <= bad_share * len(chunks)
    return len(w), len(text) - spaces, symbols, dup, again, whole, len(chunks), bad, failed, kept


def quality_rules(docs: DataFrame, level: int = 3, **limits) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and the columns of OUT."""

    @F.pandas_udf(OUT)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level).compress
        names = [x.split()[0] for x in OUT.split(", ")]
        for x in texts:
            yield pd.DataFrame([judge(t, lambda b: len(press(b)) / len(b), **limits) for t in x], columns=names)

    return docs.select("doc_id", judged("text").alias("q")).select("doc_id", "q.*")
