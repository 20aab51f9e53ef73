"""Language identification by compression.

Each language has a dictionary: raw content, cut from a bounded sample of labelled texts. Texts are brought to lower
case and to letters only, cut into chunks of 64 KB, and each chunk is compressed once with every dictionary; the
language with the fewest bytes in total wins, and score is a softmax of the bytes saved. A text is rejected when the
margin between the best two, per byte of the chunks' heads (what a dictionary can tell; later the chunk itself is the
better dictionary), is narrow. Dictionaries are sampled without regard to a text's rank in the table: the rows with the least digests of
their ids, as many as fill a dictionary.

Defined cases: null texts and texts without a letter are `und`, score 0, rejected; ties go to the language that comes
first by code point; without any learnable row all texts are `und`; texts of any length are read whole, chunk by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


UNDETERMINED = "und"
#: Bounds of what is learned from: bytes of a dictionary, characters taken of a text, texts of a language.
DICTIONARY, EXCERPT, TEXTS = 16 << 10, 2_000, 96
#: Bytes compressed at once, and how hard the coder looks for matches.
CHUNK = 64 << 10
CODER = {"window_log": 17, "chain_log": 13, "hash_log": 13, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
BARE = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
#: Bytes saved over the second best language, per byte of the first HEAD bytes of each chunk, that a decision needs.
MARGIN, HEAD = 0.002, 4096
NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def plain(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """From rows (doc_id, text, lang): a dictionary a language, of at most TEXTS excerpts and DICTIONARY bytes."""
    kept = labelled.where("lang is not null and text is not null and length(trim(text)) > 0")
    kept = kept.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("_digest"), F.xxhash64("text").alias("_text"))
    # ids without texts, and the least of 64 salts first, so that no task holds a whole language
    ids = kept.select("lang", "_digest", "_text").withColumn("_salt", F.pmod(F.shiftright("_digest", 8), F.lit(64)))
    salted = Window.partitionBy("lang", "_salt").orderBy("_digest", "_text")
    few = ids.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= TEXTS // 8).drop("_n")
    least = Window.partitionBy("lang").orderBy("_digest", "_text")
    few = few.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= TEXTS).select("lang", "_digest", "_text", "_n").distinct()
    rows = kept.withColumn("text", F.substring("text", 1, EXCERPT)).join(F.broadcast(few), ["lang", "_digest", "_text"])  # TEXTS rows a language
    picked = rows.dropDuplicates(["lang", "_n"]).orderBy("lang", "_n").select("lang", "text").collect()
    texts: dict[str, list[str]] = {}
    for lang, text in picked:
        texts.setdefault(lang, []).append(text)
    out = {}
    for lang in sorted(texts):
        share = max(100, DICTIONARY // len(texts[lang]))
        out[lang] = b"\n".join(plain(t)[:share] for t in texts[lang])[:DICTIONARY]
    return out


class Coder:
    """Sizes of a text under each dictionary; made once in a task."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.coders = []
        for data in content.values():
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters(**CODER, **BARE)
            held.precompute_compress(compression_params=options)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, compression_params=options))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        data = plain(text or "")
        if not data or not self.langs:
            return UNDETERMINED, 0.0, False
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        gaps = [(s - sizes[best]) / 8 for s in sizes]
        score = 1 / sum(math.exp(-min(g, 700.0)) for g in gaps)
        second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + len(data))
        return self.langs[best], score, (second - sizes[best]) >= MARGIN * sum(min(len(x), HEAD) for x in chunks) and second > sizes[best]


def identified(docs: DataFrame, content: dict[str, bytes], columns: list[str]) -> DataFrame:
    """columns of docs with lang_pred, score and accepted."""
    held = docs.sparkSession.sparkContext.broadcast(content)  # languages x DICTIONARY bytes
    cache: dict[str, Coder] = {}

    @F.pandas_udf("lang string, score double, accepted boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = cache.setdefault("coder", Coder(held.value)) if "coder" not in cache else cache["coder"]
        for texts in batches:
            yield pd.DataFrame([coder.classify(t) for t in texts], columns=["lang", "score", "accepted"])

    ours = {"lang_pred", "score", "accepted"}
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), of(docs["text"]).alias("_l"))
    return rows.select(
        *(F.col("_row")[c].alias(c) for c in columns if c.lower() not in ours),
        F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"), F.col("_l.accepted").alias("accepted"),
    )
