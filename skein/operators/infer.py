"""Python-worker escape hatches.

Everything else in skein is JVM expressions. These run user code over
Arrow batches with ``mapInPandas`` / ``mapInArrow``: the user object
(model, tokenizer) is built once per Python worker and reused for every
batch, never per row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _cached(name: str, factory: Callable):
    """The object ``factory`` builds, once per Python worker process.

    Functions of this package are pickled by value, so a module global would
    be a fresh copy in every task; the cache lives in a module that only the
    worker process owns and is keyed by an explicit name."""
    import sys
    import types
    home = sys.modules.setdefault("_skein_worker_objects", types.ModuleType("_skein_worker_objects"))
    if name not in home.__dict__:
        home.__dict__[name] = factory()
    return home.__dict__[name]


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to every row (as a dict); Arrow-batched transport.

    An escape hatch at Python speed, one dict per row; ``map_batches`` is the
    fast form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([fn(r) for r in pdf.to_dict("records")])

    return df.mapInPandas(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType,
                partitions: int | None = None) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; ``partitions`` sets the number
    of parallel tasks (the reference's ``num_proc``). Source columns not in
    ``schema`` are dropped (the reference's ``remove_columns``)."""
    if partitions:
        df = df.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def batch_infer(df: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], prompt: str,
                keys: list[str], out: str = "completion", name: str | None = None) -> DataFrame:
    """U4: run a user model over a prompt table; ``factory()`` builds the model
    once per worker and returns ``predict(list_of_prompts) -> list_of_texts``.
    Calls that give the same ``name`` share the built object; by default each
    call has its own."""
    name = name or f"object-{uuid.uuid4().hex}"
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
                       + [f"{out} string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = _cached(name, factory)
        for pdf in batches:
            res = pdf[keys].copy()
            res[out] = predict(pdf[prompt].fillna("").tolist())
            yield res

    return df.select(*keys, prompt).mapInPandas(run, schema)


def tokenize_with(df: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[int]]]], text: str,
                  out: str = "ids", name: str | None = None) -> DataFrame:
    """Tokenize with a user-supplied tokenizer (loaded once per worker; ``name`` as in ``batch_infer``).

    All columns stay; rows leave in slices of about 1 MB of text, so a worker holds the ids of one slice."""
    name = name or f"object-{uuid.uuid4().hex}"
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa
        encode = _cached(name, factory)
        for b in batches:
            for lo, texts in _slices(b.column(at)):
                yield _with_lists(b.slice(lo, len(texts)), encode(texts), pa.int32(), out)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _with_lists(batch, lists, kind, out: str):
    """A record batch with one more column of lists of numbers."""
    import numpy as np
    import pyarrow as pa
    cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in lists]])
    return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(cut), pa.array(flat, kind))],
                                      names=[*batch.schema.names, out])


def _slices(texts, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about ``chars`` characters (one text at least) of an Arrow column; null is empty."""
    part, held, lo = [], 0, 0
    for i, x in enumerate(texts):
        t = x.as_py() or ""
        if part and held + len(t) > chars:
            yield lo, part
            part, held, lo = [], 0, i
        part.append(t)
        held += len(t)
    if part:
        yield lo, part


def byte_tokenizer_factory(offset: int = 2) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """A user tokenizer in plain Python: UTF-8 bytes + offset (the same ids as
    the native byte tokenizer, which makes the UDF path checkable)."""

    def factory():
        def encode(texts: list[str]) -> list[list[int]]:
            return [[b + offset for b in t.encode("utf-8")] for t in texts]
        return encode

    return factory


def tail_echo_factory(n: int = 16) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A stand-in model: returns the prompt's last ``n`` characters and its
    length. Deterministic, so the inference path can be checked."""

    def factory():
        def predict(prompts: list[str]) -> list[str]:
            return [f"{p[-n:]}|{len(p)}" for p in prompts]
        return predict

    return factory


def _json_tokenizer(shared):
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(shared.value)
    t.encode_special_tokens = True            # their names within a text are ordinary text
    return t


def json_tokenizer_factory(spark, path: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """The encoder of a tokenizer file (``tokenizers`` JSON, a few MB, read by the driver and broadcast)."""
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def factory():
        t = _json_tokenizer(shared)

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        return encode

    return factory


def json_decoder_factory(spark, path: str) -> Callable[[], Callable[[list[list[int]]], list[str]]]:
    """T3 for the same files: ids back to texts."""
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def factory():
        t = _json_tokenizer(shared)
        return lambda ids: [t.decode(list(x), skip_special_tokens=False) for x in ids]

    return factory


def decode_with(df: DataFrame, factory: Callable[[], Callable[[list[list[int]]], list[str]]], ids: str,
                out: str = "decoded", name: str | None = None) -> DataFrame:
    """T3 with a user-supplied decoder, loaded once per worker; NULL ids give an empty text."""
    name = name or f"object-{uuid.uuid4().hex}"
    at = df.columns.index(ids)

    def run(batches):
        import pyarrow as pa
        decode = _cached(name, factory)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                texts = decode([[] if x is None else x for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


ROWS = 64                                      # rows whose ids are Python numbers at a time


def _ranked(shared, pattern: str):
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_tokenizer_factory(spark, path: str, pattern: str) -> tuple[Callable, Callable]:
    """(encoder, decoder) factories of a file of byte-level BPE ranks (a few MB, read by the driver and
    broadcast); ``pattern`` cuts texts into words. Special tokens' names within a text are ordinary text."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def encoder():
        t = _ranked(shared, pattern)
        return lambda texts: [t.encode_ordinary(x) for x in texts]

    def decoder():
        t = _ranked(shared, pattern)
        return lambda ids: [t.decode_bytes(x).decode("utf-8") for x in ids]

    return encoder, decoder


SYMBOLS = 27                                   # a to z, and one for everything else


def bigram_costs(df: DataFrame, text: str = "text") -> list[int]:
    """A character model: the cost in thousandths of a nat of each of the 27 x 27 symbol pairs, at 27 x first + second
    (space 0, a to z 1 to 26), with one added to each count. Counts cover all texts; 729 rows reach the driver."""
    def count(batches):
        import numpy as np
        import pyarrow as pa
        code = _symbol_codes()
        for b in batches:
            n = np.zeros(SYMBOLS * SYMBOLS, np.int64)
            for x in b.column(0):
                c = _symbols(x.as_py() or "", code)
                n += np.bincount(c[:-1] * SYMBOLS + c[1:], minlength=len(n))
            p = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(n[p])], names=["p", "n"])

    rows = df.select(F.col(text).cast("string")).mapInArrow(count, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    import math
    got = [0] * (SYMBOLS * SYMBOLS)
    for r in rows:
        got[r["p"]] = r["n"]
    first = [sum(got[a * SYMBOLS:(a + 1) * SYMBOLS]) for a in range(SYMBOLS)]
    return [round(1000 * math.log((first[p // SYMBOLS] + SYMBOLS) / (n + 1))) for p, n in enumerate(got)]


def _symbol_codes():
    import numpy as np
    code = np.zeros(256, np.int64)
    code[97:123] = code[65:91] = np.arange(1, SYMBOLS)
    return code


def _symbols(text: str, code):
    """The symbol of every character: a character beyond ASCII is one "other"."""
    import numpy as np
    return code[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def bigram_scorer_factory(costs: list[int]) -> Callable[[], Callable[[list[str]], list[str]]]:
    """U4: a model that returns a prompt's negative log-likelihood under ``bigram_costs``, as a decimal integer."""
    def factory():
        import numpy as np
        cost = np.array(costs, np.int64)
        code = _symbol_codes()

        def predict(prompts: list[str]) -> list[str]:
            out = []
            for p in prompts:
                c = _symbols(p, code)
                out.append(str(int(cost[c[:-1] * SYMBOLS + c[1:]].sum())))
            return out
        return predict

    return factory
