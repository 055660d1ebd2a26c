"""D3 + S14: incremental inversion of a growing corpus by signed deltas.

An epoch (one crawl) is delivered as its documents and citation edges, and may be delivered again.  Then its old rows are
retracted and the new ones added: both are summed with signs, what did not change cancels out, and only the rest is
carried into the stored tables

    counts     (id, citations)
    merged     (id, doc_id, title, size, n_merged): the merged document of each key
    incoming   (id, chunk, n_chunks, incoming): the chunks of the keys' citation lists

which lie in buckets of their keys.  A delivery reads and rewrites the buckets of the keys it changes, and no others; within a bucket
unchanged keys are copied.  Per epoch, its edges and its own merged documents are kept, so that it can be retracted and a
key's next best document found.

Every delivery writes new folders and then a manifest that names, for each table and bucket, the folder in force.  The
manifest's commit makes the delivery visible at once; a run that is lost before leaves the state as it was,
and repeating it is safe.  Folders that no manifest names any more can be deleted with ``drop_old``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions import constants as K
from citegraph.operators.sampling import md5_uniform
from citegraph.sources.files import committed, delete

EDGE = "citing_id long, pos int, cited_id long, title string, authors array<array<string>>"
DOC = "id long, doc_id long, title string, size long, n long"
SCHEMAS = {
    "counts": "id long, citations long",
    "merged": "id long, doc_id long, title string, size long, n_merged long",
    "incoming": "id long, chunk long, n_chunks long, incoming array<struct<citing_id: long, pos: int, title: string, authors: array<array<string>>>>",
}
#: folders a table is cut into by its keys
BUCKETS = 64


class Inversion:
    """The inverted corpus stored below ``root`` (a shared folder)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, chunk_size: int = K.INVERT_VALUES_PER_KEY):
        self.spark, self.root, self.chunk_size = spark, root.rstrip("/"), chunk_size
        self.version, state = self._newest()
        self.state = state or {"buckets": buckets, "epochs": {}, "tables": {t: {} for t in SCHEMAS}}
        self.buckets = self.state["buckets"]

    # -------------------------------------------------------------- manifest
    def _newest(self) -> tuple[int, dict | None]:
        done = committed(self.spark, f"{self.root}/manifest", "v=*")
        if not done:
            return 0, None
        version = max(int(p.rsplit("v=", 1)[1]) for p in done)
        rows = self.spark.read.text(f"{self.root}/manifest/v={version}", wholetext=True).collect()  # one small file
        return version, json.loads(rows[0].value)

    def _commit(self, state: dict) -> None:
        """A folder counts once Spark's writer has marked it as complete."""
        text = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        text.write.mode("overwrite").text(f"{self.root}/manifest/v={self.version + 1}")
        self.version, self.state = self.version + 1, state

    # -------------------------------------------------------------- tables
    def _bucket(self, key: str = "id"):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def _read(self, paths, schema: str) -> DataFrame:
        if paths:
            return self.spark.read.schema(schema).parquet(*paths)
        # no rows, as Spark's planner can see: joins and unions with them fall away, and no Python worker makes them
        return self.spark.range(1).select(F.from_json(F.lit(None).cast("string"), schema).alias("x")).select("x.*").where(F.lit(False))

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A stored table, or its buckets ``only``."""
        parts = self.state["tables"][name]
        return self._read(sorted(p for b, p in parts.items() if only is None or int(b) in only), SCHEMAS[name])

    def edges(self, epoch: str) -> DataFrame:
        e = self.state["epochs"].get(epoch)
        return self._read([e["edges"]] if e else [], EDGE)

    def documents(self, epochs, only: list[int] | None = None) -> DataFrame:
        """The epochs' own merged documents ``(id, doc_id, title, size, n)`` in the buckets ``only``."""
        paths = [f"{e['documents']}/bucket={b}" for x in epochs if (e := self.state["epochs"].get(x)) for b in e["buckets"] if only is None or b in only]
        return self._read(paths, DOC)

    # -------------------------------------------------------------- delivery
    def deliver(self, epoch: str, docs: DataFrame, edges: DataFrame) -> dict:
        """Put (or replace) an epoch: ``docs`` (id, doc_id, title, size) and ``edges`` (citing_id, pos, cited_id, cited_title, authors).

        Returns the rewritten buckets by table.  Null keys take no part."""
        at = f"{self.root}/data/v={self.version + 1}"
        new_edges = edges.where("cited_id is not null").select("citing_id", F.col("pos").cast("int").alias("pos"), "cited_id", F.col("cited_title").alias("title"), "authors")
        new_edges.write.mode("overwrite").parquet(f"{at}/edges")
        own = docs.where("id is not null").groupBy("id").agg(
            F.max_by(F.struct("doc_id", "title", "size"), F.struct("size", "doc_id", "title")).alias("d"), F.count(F.lit(1)).alias("n")
        ).select("id", "d.doc_id", "d.title", F.col("d.size").cast("long").alias("size"), "n")
        own.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/documents")

        again = epoch in self.state["epochs"]
        delta = self._signed(self._read([f"{at}/edges"], EDGE), self.edges(epoch) if again else None, EDGE, f"{at}/edge-delta", "cited_id")
        filled = [int(p.rsplit("=", 1)[1]) for p in committed(self.spark, f"{at}/documents", "bucket=*", marked=False)]
        fresh = self._read([f"{at}/documents/bucket={b}" for b in filled], DOC)
        changed = self._signed(fresh, self.documents([epoch]) if again else None, DOC, f"{at}/document-delta", "id").select("id", "bucket").distinct()

        # at most `buckets` numbers each
        edge_buckets = sorted(r.bucket for r in delta.select("bucket").distinct().collect())
        doc_buckets = sorted(r.bucket for r in changed.select("bucket").distinct().collect())
        state = json.loads(json.dumps(self.state))
        state["epochs"][epoch] = {"edges": f"{at}/edges", "documents": f"{at}/documents", "buckets": filled}

        if edge_buckets:
            self._write("counts", self._counts(delta, edge_buckets), at, edge_buckets, state)
            self._write("incoming", self._incoming(delta, edge_buckets), at, edge_buckets, state)
        if doc_buckets:
            self._write("merged", self._merged(changed, fresh, epoch, doc_buckets), at, doc_buckets, state)
        self._commit(state)
        delete(self.spark, f"{at}/edge-delta")
        delete(self.spark, f"{at}/document-delta")
        return {"counts": edge_buckets, "incoming": edge_buckets, "merged": doc_buckets}

    def _signed(self, new: DataFrame, old: DataFrame | None, schema: str, path: str, key: str) -> DataFrame:
        """What is in ``new`` and not in ``old`` with a positive ``sign`` (its multiplicity), and the reverse with a negative
        one.  Without ``old`` (none) every row of ``new`` stands for itself: readers add the signs up."""
        if old is None:
            return new.withColumn("sign", F.lit(1).cast("long")).withColumn("bucket", self._bucket(key))
        both = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        cols = [c for c in both.columns if c != "sign"]
        delta = both.groupBy(*cols).agg(F.sum("sign").alias("sign")).where("sign <> 0").withColumn("bucket", self._bucket(key))
        delta.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(f"{schema}, sign long, bucket int").parquet(path)

    def _counts(self, delta: DataFrame, only: list[int]) -> DataFrame:
        added = delta.groupBy(F.col("cited_id").alias("id")).agg(F.sum("sign").alias("citations"))
        return self.table("counts", only).unionByName(added).groupBy("id").agg(F.sum("citations").alias("citations")).where("citations > 0")

    def _incoming(self, delta: DataFrame, only: list[int]) -> DataFrame:
        """The lists of the delta's keys, citation by citation with its sign, dealt anew; other keys' chunks as they are."""
        keys = delta.select(F.col("cited_id").alias("id")).distinct()
        old = self.table("incoming", only)
        listed = old.join(keys, "id", "left_semi").select("id", F.explode("incoming").alias("c")).select("id", "c.*", F.lit(1).cast("long").alias("sign"))
        rows = listed.unionByName(delta.select(F.col("cited_id").alias("id"), "citing_id", "pos", "title", "authors", "sign"))
        rows = rows.groupBy("id", "citing_id", "pos", "title", "authors").agg(F.sum("sign").alias("sign")).where("sign > 0")
        n = rows.groupBy("id").agg(F.ceil(F.sum("sign") / self.chunk_size).alias("n_chunks"))
        rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "sign"))).join(n, "id")
        rows = rows.withColumn("chunk", F.pmod(md5_uniform("citing_id", "pos"), F.col("n_chunks")))
        lists = rows.groupBy("id", "chunk", "n_chunks").agg(F.array_sort(F.collect_list(F.struct("citing_id", "pos", "title", "authors"))).alias("incoming"))
        return old.join(keys, "id", "left_anti").unionByName(lists.select(old.columns))

    def _merged(self, changed: DataFrame, fresh: DataFrame, epoch: str, only: list[int]) -> DataFrame:
        """The changed keys' documents from all epochs' own ones; other keys as they are."""
        others = [x for x in self.state["epochs"] if x != epoch]
        keys = changed.select("id")
        rows = self.documents(others, only).unionByName(fresh).join(keys, "id", "left_semi")
        best = rows.groupBy("id").agg(F.max_by(F.struct("doc_id", "title", "size"), F.struct("size", "doc_id", "title")).alias("d"), F.sum("n").alias("n_merged"))
        return self.table("merged", only).join(keys, "id", "left_anti").unionByName(best.select("id", "d.*", "n_merged"))

    def _write(self, name: str, df: DataFrame, at: str, only: list[int], state: dict) -> None:
        """The buckets ``only`` of a table in a new folder, and their places in ``state`` (none for a bucket without rows)."""
        df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/{name}")
        filled = {int(p.rsplit("=", 1)[1]) for p in committed(self.spark, f"{at}/{name}", "bucket=*", marked=False)}
        for b in only:
            state["tables"][name].pop(str(b), None)
            if b in filled:
                state["tables"][name][str(b)] = f"{at}/{name}/bucket={b}"

    def drop_old(self) -> int:
        """Delete the version folders that the newest manifest does not name; returns how many."""
        named = {p for t in self.state["tables"].values() for p in t.values()} | {e[k] for e in self.state["epochs"].values() for k in ("edges", "documents")}
        gone = [p for p in committed(self.spark, f"{self.root}/data", "v=*", marked=False) if not any(f"/{p.rsplit('/', 1)[1]}/" in x for x in named)]
        for p in gone:
            delete(self.spark, p)
        return len(gone)

    def inverted(self) -> DataFrame:
        """``(id, doc_id, title, n_merged, citations)``: every merged document with its number of citations."""
        return self.table("merged").join(self.table("counts"), "id", "left").select("id", "doc_id", "title", "n_merged", F.coalesce("citations", F.lit(0)).alias("citations"))
