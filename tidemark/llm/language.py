"""Language identification by compression with one zstandard raw-content dictionary per language.

Each language's dictionary is plain sample text. A text is cut into chunks, every chunk is compressed with
every dictionary, and the language with the smallest total wins: what looks like the sample text is coded as
references into it. Chunking keeps a long text from drowning the dictionary in its own history; all of the
text is used. Texts and samples are first reduced to lower-case words, so capitals, marks and digits don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import mapped

DICTIONARY_BYTES = 256 << 10
SAMPLE_ROWS = 400  # labelled texts per language that a dictionary is drawn from
SAMPLE_CHARS = 800
CHUNK_BYTES = 8 << 10
LEVEL = 9
MARGIN = 0.01  # of the bytes of the best language
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_BARE = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or 97 <= c < 123 else 32 for c in range(256))


def bare(text: str) -> bytes:
    """Lower-case runs of letters (and of characters beyond ASCII), one space between them."""
    return b" ".join(text.lower().encode().translate(_BARE).split())


def dictionaries(df: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Sample text by language from a bounded hash sample (SAMPLE_ROWS texts a language, SAMPLE_CHARS of each).

    Only rows with a label and a letter take part. The sample is what has the smallest hashes of the text, so it
    depends on the rows alone, not on their order. Distinct languages are few: labels, not documents.
    """
    # a piece from the middle: what documents share tends to stand at their ends
    at = F.greatest(F.lit(1), ((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    pieces = rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("piece")).distinct()
    # a bounded number of slots per language: each keeps its least hash, by ordinary partial aggregation
    slots = pieces.groupBy("lang", F.pmod("h", F.lit(SAMPLE_ROWS)).alias("slot")).agg(F.min_by("piece", "h").alias("piece"))
    found = slots.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("slot", "piece"))).alias("pieces")).collect()
    return {r["lang"]: bare("\n".join(p["piece"] for p in r["pieces"]))[-DICTIONARY_BYTES:] for r in found}


def _classify(samples: dict[str, bytes]):
    names = sorted(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for name in names:
            d = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))
        for batch in batches:
            best, score, margin = [], [], []
            for text in batch["text"].to_pylist():
                if not names or text is None or not _LETTER.search(text):
                    best.append(UNDETERMINED)
                    score.append(0.0)
                    margin.append(0.0)
                    continue
                data = bare(text)
                sizes = [sum(len(c.compress(data[k : k + CHUNK_BYTES])) for k in range(0, len(data), CHUNK_BYTES)) for c in coders]
                order = sorted(range(len(names)), key=lambda k: (sizes[k], names[k]))
                first = sizes[order[0]]
                second = sizes[order[1]] if len(order) > 1 else 2 * first
                best.append(names[order[0]])
                margin.append(second / first - 1)
                score.append(min(1.0, second / first - 1))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["row"], pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["key", "row", "lang_pred", "score", "margin"])

    return run


def identify(df: DataFrame, samples: dict[str, bytes], *, key: str = "doc_id", text: str = "text", margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """key, lang_pred, score, accepted and the columns ``keep`` of every row, one for one.

    lang_pred is the language with the smallest compressed size, ties to the first name; ``und`` where the text
    is null, empty or without a letter, or no language was learned. score is how much larger the second best is,
    as a share, 1 at most. accepted is false for ``und`` and where that share is below ``margin``.
    """
    kept = keep or []
    rows = df.select(F.col(key).alias("key"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("pad")).alias("row"), F.col(text).alias("text"))
    schema = rows.select("key", "row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin")).schema
    out = mapped(rows, _classify(samples), schema)
    return out.select(
        F.col("key").alias(key), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept) if c != key], "lang_pred", "score",
        ((F.col("lang_pred") != UNDETERMINED) & (F.col("margin") >= margin)).alias("accepted"),
    )
