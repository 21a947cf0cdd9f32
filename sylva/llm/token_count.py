"""Token counts: Arrow functions that return lengths only.

A byte-level BPE never merges across the pieces of its splitting pattern, so the tokens of a text are those of its
pieces. Texts are cut into pieces, each piece is encoded by the library once and its length is remembered.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, read

TOKENIZER = "byte_bpe_50k.json"
# Fixed value: the splitting pattern of byte-level BPE, white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of text in a batch, characters of a part of a long text and of those whose pieces the library sees at once, pieces
#: remembered by a task, the longest of them.
BATCH, PART, BATCH_PART, MOST_PIECES, LONGEST_PIECE = 4 << 20, 1 << 16, 1 << 19, 400_000, 64


#: Where every piece ends, whatever stands around: after a letter no letter follows, after a digit no digit.
SAFE = r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})"


def parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts that are cut at the ends of runs of letters or digits; a run that is longer is one piece, and whole."""
    import regex

    safe, start = regex.compile(SAFE), 0
    while len(text) - start > size and (m := safe.search(text, start + size)) and m.start() < len(text):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to numbers of tokens, as the library of the file gives them, nothing added or cut."""
    if not os.path.exists(tokenizer):
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.no_truncation()
    model.no_padding()
    encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] or " " in a["content"] for a in added):
        return encode
    import regex

    cut, known = regex.compile(PATTERN), {}
    special = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None

    def learn(held: list[tuple[int, list[str]]], out: list[int]) -> None:
        """Adds the tokens of pieces to their texts; what is new in all of them goes to the library as one batch."""
        unknown = list({p for _, pieces in held for p in pieces if p not in known})
        if len(known) > MOST_PIECES:
            known.clear()
            unknown = list({p for _, pieces in held for p in pieces})
        known.update(zip(unknown, encode(unknown), strict=True))
        for i, pieces in held:
            out[i] += sum(map(known.__getitem__, pieces))
        for p in unknown:
            if len(p) > LONGEST_PIECE:
                del known[p]

    def count(texts: list[str]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            within = special.split(text) if special else [text]
            out[i] += len(within) - 1
            for part in (p for w in within for p in parts(w)):
                held.append((i, cut.findall(part)))
                size += len(part)
                if size >= BATCH_PART:
                    learn(held, out)
                    held, size = [], 0
        learn(held, out)
        return out

    return count


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, *, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit: more than limit tokens), a row for each row of docs.

    Null and empty texts have no tokens; repeated rows and rows with a null id are counted each. Other columns are not
    read, whatever their names. Texts are counted whole; with a tokenizer whose pieces are not those of byte-level BPE, a
    text goes to the library in one piece. Special strings inside texts count as the library's default has it. tokenizer
    is a path, or a name that public_tokenizers knows on the executor.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in byte_slices(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(count([t or "" for t in b.column("text").to_pylist()]), pa.int64())], ["id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = own.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", doc_id).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
