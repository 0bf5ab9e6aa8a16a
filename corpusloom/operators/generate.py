"""Calls of models that are plugged in: embedders, tokenizers and generators, a batch at a time."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .lineage import checkpointed

#: Provider name to a factory of clients: options -> (system, user) -> (answer or None, prompt tokens, completion tokens).
CLIENTS: dict[str, Callable] = {}


def echo_client(**options) -> Callable:
    """A stand-in that answers with the last line of the prompt."""
    return lambda system, user: (user.rsplit("\n", 1)[-1], len((system + " " + user).split()), len(user.rsplit("\n", 1)[-1].split()))


CLIENTS["echo"] = echo_client


def maker_of(provider: str) -> Callable:
    """The factory of a provider's clients, which goes to the workers from here."""
    if provider not in CLIENTS:
        raise ValueError(f"unknown provider {provider!r}, known are {sorted(CLIENTS)}")
    return CLIENTS[provider]


def client_of(provider: str, **options) -> Callable:
    return maker_of(provider)(**options)


#: What a worker process has made so far.
_made: dict = {}


def made_once(key: object, make: Callable[[], object]) -> object:
    """The same object for a key in all tasks of a worker."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in: counts of hashed words at unit length; a text without words has the zero vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            length = sum(x * x for x in v) ** 0.5
            out.append([x / length for x in v] if length else v)
        return out

    return embed


def embedded(rows: DataFrame, column: str, make: Callable[[], Callable] = hashing_embedder, prefix: str = "", name: str | None = None) -> DataFrame:
    """Adds embedding array<float>; make is called once a task, or once a worker for a model with a name. Queries take an instruction
    as prefix, passages none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = made_once(("model", name), make) if name else make()
        for texts in batches:
            yield pd.Series(model([prefix + (t or "") for t in texts]))

    return rows.withColumn("embedding", run(F.col(column)))


def token_counts(column: Column, make: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Tokens of each text by a plugged-in tokenizer, without special ones; make is called once a task, and gives a function from texts
    to their numbers of tokens."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = make()
        for texts in batches:
            yield pd.Series(counts([t or "" for t in texts]), dtype="int64")

    return run(column)


def library_tokenizer(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """For token_counts: a vocabulary file of the tokenizers library."""

    def make() -> Callable[[list[str]], list[int]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return make


def call_key(row_prompt: str, system: str, provider: str) -> str:
    """The same for the same call, so that a provider can tell a call that is made again when a task is run again."""
    return hashlib.blake2b("\x1f".join((provider, system, row_prompt)).encode(), digest_size=16).hexdigest()


def answered(rows: DataFrame, provider: str, system: str = "", retries: int = 5, concurrency: int | None = None, batch_calls: int = 8, **options) -> DataFrame:
    """Adds prediction (empty where the model gave none), prompt_tokens, completion_tokens, latency_s to rows with a prompt (null:
    empty).

    A worker keeps one client and makes batch_calls calls at a time; `concurrency` bounds the tasks that call at once. A client that has
    an attribute `idempotent` gets the call's key as a third argument, so a call made again by a lost task is not paid twice.
    """
    if concurrency:
        rows = rows.repartition(concurrency)
    maker = maker_of(provider)
    fields = [*rows.schema.fields, StructField("prediction", StringType()), StructField("prompt_tokens", LongType()), StructField("completion_tokens", LongType()), StructField("latency_s", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = made_once((provider, tuple(sorted(options.items()))), lambda: maker(**options))

        def once(prompt: str) -> tuple:
            more = (call_key(prompt, system, provider),) if getattr(call, "idempotent", False) else ()
            for k in range(retries + 1):
                try:
                    began = time.monotonic()
                    answer, asked, given = call(system, prompt, *more)
                    return (answer or "").strip(), asked, given, time.monotonic() - began
                except (ConnectionError, TimeoutError):
                    if k == retries:
                        raise
                    time.sleep(min(30, 2**k))
            raise AssertionError

        with ThreadPoolExecutor(batch_calls) as pool:
            for batch in batches:
                got = list(pool.map(once, (p or "" for p in batch.column("prompt").to_pylist())))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
                added = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[f.name for f in fields])

    return rows.mapInArrow(run, StructType(fields))


LEDGER = "call string, prediction string, prompt_tokens long, completion_tokens long, latency_s double"
SALTS = 64


def call_of(prompt: Column, provider: str, system: str = "", **options) -> Column:
    """The key of a call: what is asked, of whom, and how."""
    asked = f"{provider}\x1f{system}\x1f{sorted(options.items())}\x1f"
    return F.sha2(F.concat(F.lit(asked), F.coalesce(prompt, F.lit(""))), 256)


def answered_once(rows: DataFrame, provider: str, ledger: str, system: str = "", calls_per_task: int = 200, **more) -> DataFrame:
    """As `answered`, with a ledger, a folder of answers by call key, so that no recorded call is made again: not for rows with equal prompts,
    nor when the work is started anew after it broke off.

    Calls that the ledger lacks are dealt to tasks of calls_per_task, and a task's answers are committed to the ledger when it ends,
    whatever becomes of the job. A task that is lost has recorded nothing and makes its calls again; a client that has the attribute
    `idempotent` is told their keys. `more`: retries, concurrency, batch_calls and the client's options. A broken-off job is
    started anew by calling this again.
    """
    spark = rows.sparkSession
    options = {k: v for k, v in more.items() if k not in ("retries", "concurrency", "batch_calls")}
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(where)
    rows = checkpointed(rows.withColumn("call", call_of(F.col("prompt"), provider, system, **options)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    known = spark.read.schema(LEDGER).parquet(ledger)
    # One row a call: equal prompts meet before they are shuffled.
    asked = checkpointed(rows.groupBy("call").agg(F.first("prompt").alias("prompt")).join(known.select("call"), "call", "left_anti"))
    n = asked.count()
    if n:
        done = answered(asked.repartition(-(-n // calls_per_task)), provider, system, **more).drop("prompt")
        done.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    # Two runs at a time may both have made a call: the first by its answer stands for both.
    found = spark.read.schema(LEDGER).parquet(ledger).groupBy("call").agg(F.min(F.struct("prediction", "prompt_tokens", "completion_tokens", "latency_s")).alias("x"))
    near = rows.select("call", "salt").distinct().join(found, "call")  # a frequent prompt meets its answer once for each salt
    return rows.join(near, ["call", "salt"]).select(*(c for c in rows.columns if c not in ("call", "salt")), "x.*")
