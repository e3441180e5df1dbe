"""Language identification by compression: a text has the language whose dictionary makes it smallest.

Each language gets a raw-content zstandard dictionary made from a bounded sample of its labelled texts: excerpts that may begin anywhere in a text.
A text is lower-cased, everything but letters becomes one space, and the whole of it is compressed in
blocks with every dictionary; blocks keep the margin between the languages in proportion to the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, spent

NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Params:
    """languages, buckets and excerpt bound the sample: at most that many excerpts of that many characters for each of the most frequent languages."""

    languages: int = 200
    buckets: int = 128
    excerpt: int = 800
    dictionary: int = 64 * 1024  # bytes; the excerpts share them
    block: int = 2048
    level: int = 6
    temperature: float = 2.0  # bytes by which a language must be smaller for e times the weight
    min_score: float = 0.35  # below it the margin is narrow
    min_gap: float = 0.02  # the margin is narrow, too, where the second language needs less than this part more bytes; a tie always is


def clean(text: str | None) -> bytes:
    """Lower-case words; nothing where no character is a letter (numerals such as one half count as words, but aren't letters)."""
    plain = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return plain.encode("utf-8", "replace") if any(map(str.isalpha, plain)) else b""


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, p: Params = Params()) -> list[tuple[str, bytes]]:
    """(language, dictionary) by descending frequency; each of the sample's buckets gives an excerpt of its text of the smallest hash.

    Null languages and texts without a letter teach nothing; without a row there is no model. Repeated rows fall into one bucket.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("id")
    begin = F.pmod(F.xxhash64(F.lit(1), "id"), F.greatest(F.lit(1), F.length("text") - p.excerpt + 1)).cast("int") + 1
    picked = cut(rows.groupBy("lang", F.pmod(h, F.lit(p.buckets)).alias("bucket")).agg(F.count("*").alias("rows"), F.min_by(F.substr("text", begin, F.lit(p.excerpt)), F.struct(h, F.col("id"), F.col("text"))).alias("text")))
    count = {r.lang: r.rows for r in picked.groupBy("lang").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "lang").limit(p.languages).collect()}
    texts: dict[str, list[bytes]] = {lang: [] for lang in count}
    for r in sorted(picked.where(F.col("lang").isin(list(count))).collect(), key=lambda r: (r.lang, r.bucket)):
        texts[r.lang].append(clean(r.text))
    spent(picked)
    order = list(count)
    return [(lang, _shared(found, p.dictionary)) for lang, found in trusted(texts, order, p).items()]


def _shared(texts: list[bytes], size: int) -> bytes:
    """The texts in one dictionary; where they are too long together, each gives its part."""
    each = size // max(1, len(texts))
    return b" ".join(texts)[:size] if sum(map(len, texts)) + len(texts) <= size else b" ".join(t[: each - 1] for t in texts)


def trusted(texts: dict[str, list[bytes]], order: list[str], p: Params) -> dict[str, list[bytes]]:
    """Drops excerpts that dictionaries made from the other half give to another language: wrong labels would draw their copies along."""
    out = {lang: [] for lang in order}
    for half in (0, 1):
        tools = compressors([(lang, _shared(texts[lang][1 - half :: 2] or texts[lang], p.dictionary)) for lang in order], p)
        for lang in order:
            for t in texts[lang][half::2]:
                sizes = [len(tool.compress(t)) for _, tool in tools]
                if order[sizes.index(min(sizes))] == lang:
                    out[lang].append(t)
    return {lang: out[lang] or texts[lang] for lang in order}


def compressors(model: list[tuple[str, bytes]], p: Params) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in model:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=p.level)
        out.append((lang, zstandard.ZstdCompressor(level=p.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, tools: list, p: Params) -> tuple[str, float, float]:
    """(language, score in 0..1, gap); ("und", 0, 0) without a letter or without a model. The more frequent language wins ties.

    The gap is what the second language needs more, as a part of the best one's bytes; infinite with one language.
    """
    data = clean(text)
    if not data or not tools:
        return "und", 0.0, 0.0
    blocks = [data[i : i + p.block] for i in range(0, len(data), p.block)]
    sizes = [sum(len(tool.compress(b)) for b in blocks) for _, tool in tools]
    least = min(sizes)
    weight = sum(math.exp(max(-700.0, (least - s) / p.temperature)) for s in sizes)
    second = sorted(sizes)[1] if len(sizes) > 1 else math.inf
    return tools[sizes.index(least)][0], 1.0 / weight, (second - least) / least


def identify(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text", p: Params = Params()) -> DataFrame:
    """The input's columns, and lang_pred, score and rejected (no letter, or a narrow margin). Columns of these names are replaced.

    Null and letterless texts give "und", 0 and rejected; equal texts give equal results, also on repeated rows. Of languages that tie the more frequent
    one is taken, and the row is rejected. Any length of text is read whole; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(shared.value, p)
        at = keep.index(text)
        for b in batches:
            found = [classify(x.as_py(), tools, p) for x in b.column(at)]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            extra = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([x == "und" or s < p.min_score or gap <= 0 or gap < p.min_gap for x, s, gap in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*keep, "lang_pred", "score", "rejected"])

    added = StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(rows, StructType([*docs.schema.fields, *added.fields]))


def held_out(id_col: str, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id is held out by nobody."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == remainder, F.lit(False))
