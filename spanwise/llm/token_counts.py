"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table from frequent pre-tokens to their token counts; its size is bounded by
``table_size``. Tier two is a cache in each Python worker: a pre-token that the table lacks is encoded by the
library once and kept, up to ``cache_size`` entries. No pre-token is ever shuffled, and no result depends on what
the table holds: it only saves encoding.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a text that holds the string of an added token is
encoded whole by the library, as its default has it; texts in scripts whose character classes could differ between
regular-expression libraries are cut by the library's own splitter. Repeated rows are counted each.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The splitting pattern of byte_bpe_50k, and characters whose classes are the same in every library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"[\t\n\r -~¡-¬®-ȳ‐-‧‰-⁞€]*"

TABLE_DOCS = 2000
TABLE_SIZE = 65_536
CACHE_SIZE = 200_000


class Lengths(dict):
    """Pre-token to number of tokens. Starts as the broadcast table; what is missing is encoded and kept."""

    def __init__(self, tokenizer, frequent: dict[str, int], cache_size: int):
        super().__init__(frequent)
        self.encode, self.frequent, self.room = tokenizer.encode, frequent, len(frequent) + cache_size

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.room:
            self.clear()
            self.update(self.frequent)
        n = self[piece] = len(self.encode(piece, add_special_tokens=False).ids)
        return n


class Counted:
    """Counts the tokens of texts as the library does."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_size: int = CACHE_SIZE):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            added = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.split, self.plain = regex.compile(SPLIT).findall, re.compile(PLAIN).fullmatch
        self.lengths = Lengths(self.tokenizer, frequent or {}, cache_size)

    def pieces(self, text: str) -> list[str]:
        if self.plain(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and self.special.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, self.pieces(text)))


def frequent_lengths(docs: DataFrame, path: str, n_docs: int = TABLE_DOCS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about n_docs sampled texts, counted where the texts are.

    A sample bounded by n_docs is enough: the table decides speed, not results. At most ``size`` entries are kept.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted, seen = Counted(path), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(counted.pieces(text))
        top = [(p, n, counted.lengths[p]) for p, n in seen.most_common(size) if len(p) < 64]
        yield pd.DataFrame(top, columns=["piece", "n", "tokens"])

    some = docs.select("text").where((F.length("text") > 0) & (F.rand(3) < n_docs / max(1, docs.count())))
    top = some.mapInPandas(count, "piece string, n long, tokens int").groupBy("piece").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))
    rows = top.orderBy(F.desc("n"), "piece").limit(size).select("piece", "tokens").toPandas()
    return dict(zip(rows["piece"], map(int, rows["tokens"]), strict=True))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, table_docs: int = TABLE_DOCS, table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    docs = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, table_docs, table_size))

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = Counted(tokenizer_path, table.value, cache_size)
        for x in texts:
            yield x.map(counted, na_action=None).astype("int64")

    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
