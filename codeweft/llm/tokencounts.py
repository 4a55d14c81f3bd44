"""Token counts as delta-maintained rollups.

The ledger is a folder. A batch of signed deltas (source, lang, tokenizer, docs, tokens: an insert
counts +1 document and +n tokens, a delete the same with minus, a revised count the difference) is
summed and stored as one small table of partial totals. Totals are the sums over the committed
batches, so a batch costs its own size and never a pass over earlier documents.

A commit is one rename of a finished folder to ``batch=<id>``: whole or not at all, and at most
once, also with two writers of one id. A batch whose id is committed already is not summed again; if
its deltas differ from those committed under that id (their order-free digest does), ValueError is
raised. ``compact`` sums the committed batches into one folder that names them and remembers their
ids; the rename that shows it also hides them, and deleting them comes after. So a writer that is lost
at any point leaves the totals and the ids as they were, and batches committed meanwhile stay.

Defined results: null source, lang or tokenizer are keys like others; a null count is 0. Repeated
rows in a batch count as often as they stand there. An empty batch commits an empty table. Keys
whose documents and tokens net to zero are left out of the totals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import WORD, shared_path, table, written

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """``counts``: source, lang, tokenizer, tokens; a row a document."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """``counts``: as for inserts, with the count that was reported before in ``old_tokens``."""
    return counts.select(
        *KEYS, F.lit(0).cast("long").alias("docs"), (F.coalesce(F.col("tokens").cast("long"), F.lit(0)) - F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))).alias("tokens")
    )


class Ledger:
    """Totals by source, language and tokenizer version in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/batches"))

    def _folders(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/batches")))

    def _committed(self, names: list[str] | None = None) -> list[str]:
        """Folders that count: all but those that a compacted one covers."""
        names = self._folders() if names is None else names
        compact = [n for n in names if n.startswith("compact=")]
        covered = set()
        if compact:
            rows = self.spark.read.schema("folder string").parquet(*[f"{self.path}/batches/{n}/covers" for n in compact])
            covered = {r["folder"] for r in rows.collect()}  # a name a folder
        return [n for n in names if n not in covered and n.startswith(("batch=", "compact="))]

    def batches(self) -> list[str]:
        """The ids of all batches that the totals hold."""
        return sorted(r["batch"] for r in self._digests(self._committed()).collect())  # a row a batch

    def _digests(self, folders: list[str]) -> DataFrame:
        """batch, digest of all these folders, by one scan."""
        schema = "batch string, digest long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/batches/{n}/digest" for n in folders])

    def _known(self, batch: str) -> list[int]:
        return [r["digest"] for r in self._digests(self._committed()).where(F.col("batch") == batch).collect()]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch; False if it was committed before."""
        if "/" in batch or not batch:
            raise ValueError(f"not a batch id: {batch!r}")
        own_name = f"staged-{uuid.uuid4().hex}"
        staged = f"{self.path}/{own_name}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.select(*[F.col(n).cast(t) for n, t in (x.split() for x in SCHEMA.split(", "))]).coalesce(1).write.parquet(f"{staged}/sums")
        # Fields of 31 bits: sums of hashes can't overflow a long.
        own = self.spark.read.schema(SCHEMA).parquet(f"{staged}/sums").agg(F.coalesce(F.sum(F.xxhash64(*KEYS, "docs", "tokens").bitwiseAND(F.lit(0x7FFFFFFF))), F.lit(0)).alias("digest"))
        digest = own.first()[0]
        before = self._known(batch)
        if not before:
            own.select(F.lit(batch).alias("batch"), "digest").coalesce(1).write.parquet(f"{staged}/digest")
            goal = f"{self.path}/batches/batch={batch}"
            if not self._fs.exists(self._path(goal)) and self._fs.rename(self._path(staged), self._path(goal)):
                if not self._fs.exists(self._path(f"{goal}/{own_name}")):
                    return True
                # Another writer came between: the folder was moved into theirs, where nothing reads it.
                self._fs.delete(self._path(f"{goal}/{own_name}"), True)
            before = self._known(batch)
        self._fs.delete(self._path(staged), True)
        if before != [digest]:
            raise ValueError(f"batch {batch} was committed with other deltas")
        return False

    def totals(self) -> DataFrame:
        folders = self._committed()
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self._summed(folders).where("docs <> 0 or tokens <> 0")

    def _summed(self, folders: list[str]) -> DataFrame:
        sums = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/batches/{n}/sums" for n in folders])
        return sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> None:
        """One table of totals in place of the committed batches."""
        present = self._folders()  # what an earlier compaction covered but could not delete stays covered
        folders = self._committed(present)
        if len(folders) < 2:
            return
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        self._summed(folders).coalesce(1).write.parquet(f"{staged}/sums")
        self._digests(folders).coalesce(1).write.parquet(f"{staged}/digest")
        self.spark.createDataFrame([(n,) for n in present], "folder string").coalesce(1).write.parquet(f"{staged}/covers")
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/batches/compact={uuid.uuid4().hex}")):
            raise OSError(f"could not show the compacted folder of {self.path}")
        for name in present:
            self._fs.delete(self._path(f"{self.path}/batches/{name}"), True)


def encoder_counts(docs: DataFrame, tokenizer_path: str, version: str, text_col: str = "text") -> DataFrame:
    """source, lang, tokenizer, tokens of a vocabulary file's encoder, for ``inserts``; a row a document."""
    coded = encode_documents(docs, tokenizer_path, text_col=text_col, keep=("source", "lang"))
    return coded.select("source", "lang", F.lit(version).alias("tokenizer"), F.col("n_tokens").alias("tokens"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """The life of ``documents`` in batches: loaded with provisional counts, counts revised, a second
    tokenizer version added, exact copies deleted; two batches arrive twice. Returns the totals; a null
    text has no tokens, null texts are copies of one another."""
    docs = table(spark, sf_dir, "documents")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    runs = F.coalesce(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")), F.lit(0))
    facts = written(
        docs.select("doc_id", "source", "lang", F.expr("ceil(length(coalesce(text, '')) / 4)").cast("long").alias("guess"), words.alias("words"), runs.alias("runs"), F.coalesce(F.md5("text"), F.lit("")).alias("digest")),
        "count-facts",
    )
    space, alnum = (facts.withColumn("tokenizer", F.lit(v)).withColumn("tokens", F.col(c)) for v, c in (("space-1", "words"), ("alnum-1", "runs")))
    # Of equal texts one row stays; what goes is all of them less that one, as sums by text, source and language: no
    # text's rows gather, and neither repeated nor missing ids matter.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang", "words", "runs")
    parts = facts.groupBy("digest", "source", "lang").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("runs").alias("runs"), F.min(row).alias("kept"))
    whole = parts.groupBy("digest").agg(F.sum("n").alias("rows"), F.min("kept").alias("kept")).where("rows > 1")
    gone = parts.drop("kept").join(whole.select("digest"), "digest", "left_semi").select("source", "lang", "n", "words", "runs")
    gone = written(gone.unionByName(whole.select("kept.source", "kept.lang", F.lit(-1).cast("long").alias("n"), (-F.col("kept.words")).alias("words"), (-F.col("kept.runs")).alias("runs"))), "gone")
    copies = [gone.select("source", "lang", F.lit(v).alias("tokenizer"), (-F.col("n")).alias("docs"), (-F.col(c)).alias("tokens")) for v, c in (("space-1", "words"), ("alnum-1", "runs"))]
    ledger = Ledger(spark, shared_path(spark, "token-ledger"))
    batches = {
        "load": inserts(space.withColumn("tokens", F.col("guess"))),
        "revise": revisions(space.withColumn("old_tokens", F.col("guess"))),
        "alnum": inserts(alnum),
        "copies": copies[0].unionByName(copies[1]),
    }
    for batch in ("load", "revise", "alnum", "revise", "copies", "alnum"):
        ledger.commit(batch, batches[batch])
    return ledger.totals().select("source", "lang", "tokenizer", "docs", "tokens")


OP1_SQL = r"""
WITH kept AS (SELECT source, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1),
counts AS (
  SELECT source, lang, 'space-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'alnum-1', len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) FROM kept)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM counts GROUP BY ALL
"""
