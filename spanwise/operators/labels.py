"""Label queries in free text: which label, which of its instances.

All steps are expressions over a table of queries, but for the last resort, a fuzzy match in a pandas UDF.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The label registry (label, caption, entity type, functions, name patterns, aliases), position and ordinal words.
LABELS = [
    ("dfc.substructure.chamber", "腔体", "face", ["enclosed"], ["chamber"], ["腔体", "腔", "内腔", "空腔", "封闭腔", "腔室", "封闭空腔", "chamber"]),
    ("dfc.substructure.cavity", "开放腔", "curve", ["cavity"], ["cavity"], ["开放腔", "开口腔", "开放空腔", "槽腔", "开腔", "cavity"]),
    ("dfc.substructure.internal_web", "内部腹板（筋）", "curve", ["stiffener"], ["stiffener", "rib"], ["筋", "加强筋", "内筋", "筋板", "腹板", "内部腹板", "隔板", "内隔板", "梁", "内部筋板", "stiffener", "web", "rib"]),
    ("dfc.substructure.web", "主壁/结构壁", "curve", ["structural", "structural_shape"], ["wall", "main_wall", "crown", "middle_rib"], ["主壁", "壁", "侧壁", "壁板", "外壁", "立壁", "结构壁", "皇冠壁", "wall", "main wall", "crown"]),
    ("dfc.substructure.flange", "翻边/法兰", "curve", ["connection"], ["flange"], ["法兰", "翻边", "连接边", "法兰面", "法兰边", "搭接边", "flange"]),
    ("dfc.substructure.notch", "凹槽/缺口", "curve", ["forming_feature"], ["notch"], ["凹槽", "缺口", "内凹", "凹口", "成型槽", "凹形特征", "notch"]),
    ("dfc.substructure.fillet", "倒角/圆角", "curve", ["transition"], ["fillet", "chamfer"], ["倒角", "圆角", "过渡圆角", "倒圆", "过渡段", "fillet", "chamfer"]),
    ("dfc.substructure.outer_contour", "外轮廓", "curve", [], ["outer_contour"], ["外轮廓", "外框", "轮廓", "外形", "外圈", "outer contour", "outline"]),
]
POSITIONS = [
    ("center", ["中间", "中部", "中央", "居中", "正中"]),
    ("top", ["上", "上部", "上面", "顶部", "顶端", "上方", "上侧"]),
    ("bottom", ["下", "下部", "下面", "底部", "底端", "下方", "下侧"]),
    ("left", ["左", "左侧", "左边", "左面"]),
    ("right", ["右", "右侧", "右边", "右面"]),
]
ORDINALS = [
    (1, ["第一", "第1", "首个", "1号", "a端", "A端"]),
    (2, ["第二", "第2", "2号", "b端", "B端"]),
    (3, ["第三", "第3", "3号", "c端", "C端"]),
    (4, ["第四", "第4", "4号"]),
]
NUMERALS = {"一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


@dataclass(frozen=True)
class Registry:
    """Labels in order; a few rows, so all look-ups are folded into expressions."""

    labels: tuple = tuple((a, b, c, tuple(d), tuple(e), tuple(f)) for a, b, c, d, e, f in LABELS)
    positions: tuple = tuple((k, tuple(w)) for k, w in POSITIONS)
    ordinals: tuple = tuple((k, tuple(w)) for k, w in ORDINALS)

    @staticmethod
    def from_yaml(text: str) -> Registry:
        """A registry file's labels, and its position and ordinal words where it has them; positions are tried in the order of POSITIONS, others after."""
        import yaml

        body = yaml.safe_load(text)
        rows = tuple((r["label_id"], r.get("caption_zh", ""), r["entity_type"], tuple(r.get("functions") or ()), tuple(r.get("name_patterns") or ()), tuple(r.get("aliases") or ())) for r in body["labels"])
        places, numbers = body.get("position_words"), body.get("ordinal_words")
        turn = {k: i for i, (k, _) in enumerate(POSITIONS)}
        return Registry(
            rows, Registry.positions if places is None else tuple((k, tuple(w or ())) for k, w in sorted(places.items(), key=lambda x: turn.get(x[0], len(turn)))),
            Registry.ordinals if numbers is None else tuple((int(k), tuple(w or ())) for k, w in sorted(numbers.items(), key=lambda x: int(x[0]))),
        )

    @staticmethod
    def read(spark: SparkSession, path: str) -> Registry:
        """From a file of a few rows in any store that Spark reads."""
        return Registry.from_yaml(spark.read.text(path, wholetext=True).first().value)

    def aliases(self) -> list[tuple[str, str]]:
        """(alias, label), the longest first, in order among equals."""
        return sorted(((a.lower(), row[0]) for row in self.labels for a in row[5]), key=lambda x: -len(x[0]))

    def of_function(self, function: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, _, _, functions, _, _ in reversed(self.labels):
            if functions:
                out = F.when(function.isin(*functions), label).otherwise(out)
        return out

    def of_name(self, name: Column) -> Column:
        """By the start of a region's name, in registry order."""
        low, out = F.lower(name), F.lit(None).cast("string")
        for label, _, _, _, patterns, _ in reversed(self.labels):
            for p in reversed(patterns):
                out = F.when(low.startswith(p), label).otherwise(out)
        return out

    def entity_type(self, label: Column) -> Column:
        return F.coalesce(*(F.when(label == row[0], row[2]) for row in self.labels))

    def caption(self, label: Column) -> Column:
        return F.coalesce(*(F.when(label == row[0], row[1]) for row in self.labels), label)


def first_word(text: Column, groups: Sequence[tuple]) -> Column:
    """The first group one of whose words is in the text."""
    low = F.lower(text)
    return F.coalesce(F.lit(None), *(F.when(_any(low, words), F.lit(k)) for k, words in groups))


def _any(low: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def selector(text: Column, compat: bool = False, registry: Registry | None = None) -> dict[str, Column]:
    """ordinal, count and position of a query.

    An ordinal such as 第二个 also reads as a count of two in the original grammar; with ``compat`` it still does, else an
    ordinal word takes its numeral out of the count.
    """
    low, registry = F.lower(text), registry or Registry()
    # A word boundary in the sense that CJK letters are word characters.
    digits = F.regexp_extract(low, r"(?U)[_\-\s](\d+)\b", 1).try_cast("int")
    letter = F.regexp_extract(low, r"(?U)[_\-\s]([a-h])\b", 1)
    ordinal = F.coalesce(digits, F.when(letter != "", F.ascii(letter) - 96), first_word(text, registry.ordinals))
    token = F.regexp_extract(text if compat else F.regexp_replace(text, r"第[一二三四五六七八九\d]+\s*[道条根个处段]?", ""), r"([一两二三四五六七八九\d]+)\s*[道条根个处段]", 1)
    count = F.coalesce(*(F.when(token == k, F.lit(v)) for k, v in NUMERALS.items()), F.when(token.rlike(r"^\d+$"), token.try_cast("int")))
    return {"ordinal": ordinal, "count": count, "position": first_word(text, registry.positions)}


def resolve(queries: DataFrame, registry: Registry | None = None, compat: bool = False) -> DataFrame:
    """queries (text, further columns) with label_id, matched, evidence, text_score, ordinal, count, position.

    In turn: the label itself (1.0), a region's name (1.0), the longest alias contained (0.95), the closest alias
    (0.5 + 0.4 ratio, from a ratio of 0.6). Nothing found gives nulls.
    """
    registry = registry or Registry()
    low = F.lower(F.trim("text"))
    exact = F.coalesce(*(F.when(low == row[0], row[0]) for row in registry.labels))
    base = F.regexp_replace(F.regexp_replace(low, r"[_\-\s]*([a-h]|\d+)$", ""), r"^[_\- ]+|[_\- ]+$", "")
    named = F.coalesce(registry.of_name(base), *(F.when(base == row[0].rsplit(".", 1)[-1], row[0]) for row in registry.labels))
    aliases = registry.aliases()
    alias = F.coalesce(*(F.when(F.contains(low, F.lit(a)), F.struct(F.lit(a).alias("alias"), F.lit(label).alias("label"))) for a, label in aliases))
    words, labels = [a for a, _ in aliases], dict(reversed(aliases))

    @F.pandas_udf("struct<alias: string, label: string, ratio: double>")
    def fuzzy(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            got = difflib.get_close_matches(t, words, n=1, cutoff=0.6) if t else []
            out.append((got[0], labels[got[0]], difflib.SequenceMatcher(None, t, got[0]).ratio()) if got else (None, None, None))
        return pd.DataFrame(out, columns=["alias", "label", "ratio"])

    out = queries.withColumns({"_low": low, "_exact": exact, "_named": named, "_base": base, "_alias": alias})
    # Only what nothing else matches is sent to Python.
    out = out.withColumn("_fuzzy", fuzzy(F.when(F.coalesce("_exact", "_named", F.col("_alias.label")).isNull(), F.col("_low"))))
    kind = [("exact_label_id", F.col("_exact"), F.col("_low"), F.lit(1.0)), ("region_name", F.col("_named"), F.col("_base"), F.lit(1.0)), ("exact_alias", F.col("_alias.label"), F.col("_alias.alias"), F.lit(0.95)), ("fuzzy_alias", F.col("_fuzzy.label"), F.col("_fuzzy.alias"), F.round(0.5 + 0.4 * F.col("_fuzzy.ratio"), 3))]
    pick = lambda i: F.coalesce(*(F.when(k[1].isNotNull(), F.lit(k[0]) if i == 0 else k[i]) for k in kind))
    out = out.withColumns({"evidence": pick(0), "label_id": pick(1), "matched": pick(2), "text_score": pick(3), **selector(F.trim("text"), compat, registry)})
    return out.drop("_low", "_exact", "_named", "_base", "_alias", "_fuzzy")
