"""Postings of text columns: made by a scan of a table, or kept as Parquet segments.

A source of postings has ``fields`` and an ``analyzer`` and gives

  postings(terms)   term, field_id, doc_id, tf, dl, positions   of the terms asked for (also by patterns), or of all
  lengths()         doc_id and an array of the fields' lengths   of every document
  vocabulary(head)  the distinct terms that start with head
  impacts(terms)    term, field_id, block, n, max_tf, min_dl     what bounds the scores of a block of documents

Document ids are whole numbers (long) or text, such as uuids; ties go by them. A row whose columns are all null is no
document. Statistics count live documents only.
"""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import SearchError
from marginalia.functions.analysis import Analyzer, stemmed
from marginalia.functions.grouping import by_terms, shape

MAX_FIELDS, MAX_TOKENS = 32, 65_535
#: Version of segments this code writes; the oldest it reads; documents in a block of impacts.
FORMAT, OLDEST, BLOCK = 2, 1, 128
#: A table of fewer bytes for each core than this may have fewer splits than there are cores, and is dealt out first.
SMALL_PER_CORE = 8 << 20


def postings_schema(key_type: str) -> str:
    return f"term string, field_id int, doc_id {key_type}, tf int, dl int, positions array<int>, block long"


POSTING = ["term", "field_id", "doc_id", "tf", "dl", "positions"]


def key_type_of(df: DataFrame, doc_id: str) -> str:
    """How ids of a column are kept: whole numbers as long, text as it is."""
    kind = df.schema[doc_id].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "long"
    if kind.startswith(("string", "varchar", "char")):
        return "string"
    raise SearchError(f'"{doc_id}" of type {kind} is no key: whole numbers and text are', "42804")


def chosen(term: Column, terms: list[str], patterns: tuple[str, ...] = ()) -> Column:
    """Whether a term is one of those asked for or matches a pattern with *."""
    out = term.isin(list(dict.fromkeys(terms))) if terms else F.lit(False)
    for x in patterns:
        out = out | term.startswith(x.split("*")[0]) & term.rlike(shape(x, r"\z"))
    return out


class Postings:
    fields: list[str]
    analyzer: Analyzer
    key_type: str = "long"
    store_positions: bool = True
    #: Options of ranking that hold unless a query gives its own.
    options: dict = {}
    #: Whether impacts() counts live documents alone.
    counts_live: bool = True

    def postings(self, terms: list[str] | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
        raise NotImplementedError

    def prefetch(self, terms: list[str], patterns: tuple[str, ...] = ()) -> None:
        """Say what several calls of postings() will ask for."""

    def lengths(self) -> DataFrame:
        raise NotImplementedError

    def vocabulary(self, head: str = "") -> DataFrame:
        """A dictionary scan; the head of the terms reaches the Parquet reader of an index."""
        return self.postings().where(F.col("term").startswith(head)).select("term").distinct()

    def impacts(self, terms: list[str] | None = None, size: int = BLOCK) -> DataFrame:
        """Of blocks made of the ids, as a scan has no order of its own."""
        block = F.floor(F.col("doc_id") / size) if self.key_type == "long" else F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
        rows = self.postings(terms).groupBy("term", "field_id", block.alias("block"))
        return rows.agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))

    def in_blocks(self, terms: list[str], blocks: DataFrame, size: int = BLOCK) -> DataFrame:
        """Postings of the terms in blocks of impacts()."""
        block = F.floor(F.col("doc_id") / size) if self.key_type == "long" else F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
        return self.postings(terms).withColumn("block", block).join(blocks, "block", "left_semi").drop("block")

    @cached_property
    def field_stats(self) -> list[tuple[int, float]]:
        """(documents, average length) per field: of one field all documents count, of several those with a word in it."""
        one = len(self.fields) == 1
        sums = []
        for i in range(len(self.fields)):
            dl = F.get("dls", F.lit(i))
            sums += [F.count(F.lit(1)) if one else F.count_if(dl > 0), F.sum(dl.cast("long"))]
        row = self.lengths().agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
        return [(row[2 * i], (row[2 * i + 1] or 0) / row[2 * i] if row[2 * i] else 1.0) for i in range(len(self.fields))]


class Scan(Postings):
    """Postings straight from a table: words that no query asks for are dropped inside the scan, and nothing is
    shuffled. The way to run few queries over a table that has no index."""

    def __init__(self, df: DataFrame, doc_id: str, fields: list[str], analyzer: Analyzer = Analyzer(), store_positions: bool = True):
        if not 1 <= len(fields) <= MAX_FIELDS:
            raise SearchError(f"an index has 1 to {MAX_FIELDS} text columns")
        kinds = dict(df.dtypes)
        for f in fields:
            if not kinds[f].startswith(("string", "varchar", "char")):
                raise SearchError(f'column "{f}" is no text column', "42804")
        self.fields, self.analyzer, self.store_positions, self.key_type = fields, analyzer, store_positions, key_type_of(df, doc_id)
        some = reduce(Column.__or__, [F.col(f).isNotNull() for f in fields])
        cores = df.sparkSession.sparkContext.defaultParallelism
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL_PER_CORE:
            df = df.select(doc_id, *dict.fromkeys(f for f in fields if f != doc_id)).repartition(cores)
        self.docs = df.where(some).select(F.col(doc_id).cast(self.key_type).alias("doc_id"), *[F.col(f).alias(f"__f{i}") for i, f in enumerate(fields)])

        self._kept: list[tuple[set[str], set[str], str]] = []

    def _texts(self) -> DataFrame:
        """doc_id, block and an array of the fields' arrays of words, which are not stemmed yet."""
        empty = F.array().cast("array<string>")
        words = F.array(*[F.coalesce(self.analyzer.words(F.col(f"__f{i}")), empty) for i in range(len(self.fields))])
        return self.docs.select("doc_id", F.floor(F.monotonically_increasing_id() / BLOCK).alias("block"), words.alias("ts"))

    def vocabulary(self, head: str = "") -> DataFrame:
        words = self._texts().select(F.explode(F.flatten("ts")).alias("term"))
        if self.analyzer.stemming:
            words = words.distinct().select(stemmed(F.array("term"))[0].alias("term"))
        return words.where(F.col("term").startswith(head)).distinct()

    def lengths(self) -> DataFrame:
        if self._kept:
            return self._read(self._kept[0][2]).select("doc_id", "dls")
        return self._texts().select("doc_id", F.transform("ts", F.size).alias("dls"))

    def _read(self, path: str) -> DataFrame:
        return self.docs.sparkSession.read.schema(forward_schema(self.key_type)).parquet(path)

    def _narrow(self, terms: list[str], patterns: tuple[str, ...]) -> DataFrame:
        made = by_terms(len(self.fields), self.analyzer.stemming, True, False, list(terms), tuple(patterns))
        return self._texts().mapInArrow(made, forward_schema(self.key_type))

    def prefetch(self, terms: list[str], patterns: tuple[str, ...] = ()) -> None:
        """One pass over the texts for all that a query reads: lengths and the postings of its terms go to the scratch
        folder. Without one the texts are passed over each time."""
        if any(set(terms) <= t and set(patterns) <= p for t, p, _ in self._kept):
            return
        try:
            path = folder_for(self.docs.sparkSession, "scan")
        except SearchError:
            return
        self._narrow(terms, patterns).write.parquet(path)
        self._kept.append((set(terms), set(patterns), path))

    def postings(self, terms: list[str] | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
        if terms is None:
            made = by_terms(len(self.fields), self.analyzer.stemming, True, True)
            return self._texts().mapInArrow(made, postings_schema(self.key_type)).select(*POSTING)
        self.prefetch(terms, patterns)
        path = next((at for t, p, at in self._kept if set(terms) <= t and set(patterns) <= p), None)
        rows = self._narrow(terms, patterns) if path is None else self._read(path)
        return inverted(rows, True, terms, patterns).select(*POSTING)

    def forward(self) -> DataFrame:
        """A row a document with all it takes to index it: doc_id, dls, block and its postings by field."""
        made = by_terms(len(self.fields), self.analyzer.stemming, self.store_positions, False)
        return self._texts().mapInArrow(made, forward_schema(self.key_type))


def forward_schema(key_type: str) -> str:
    return f"doc_id {key_type}, dls array<int>, block long, ps array<array<struct<term:string,positions:array<int>>>>"


def inverted(rows: DataFrame, store_positions: bool, terms: list[str] | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
    """The postings in rows of forward(), with their block."""
    rows = rows.select("doc_id", "dls", "block", F.posexplode("ps").alias("field_id", "p"))
    if terms is not None:
        rows = rows.withColumn("p", F.filter("p", lambda x: chosen(x["term"], terms, patterns)))
    rows = rows.select("doc_id", "field_id", "block", F.col("dls")[F.col("field_id")].alias("dl"), F.explode("p").alias("p"))
    positions = F.col("p.positions") if store_positions else F.lit(None).cast("array<int>")
    return rows.select(F.col("p.term").alias("term"), "field_id", "doc_id", F.size("p.positions").alias("tf"), "dl", positions.alias("positions"), "block")


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or where that is unset and the session runs
    on one machine alone, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SearchError("an index needs a path, or spark.checkpoint.dir set to a folder that all executors share", "55000")
        base = tempfile.mkdtemp(prefix="marginalia-")
    return f"{base.rstrip('/')}/search/{uuid.uuid4().hex}-{name}"


class Index(Postings):
    """Parquet segments under a folder, listed by numbered manifests: a change writes its data, then a manifest, so
    readers see all of it or nothing, and go on reading what they began with.

    Added documents are visible at once: they are kept as pending rows, in the order in which they came, until there
    are ``seal_tokens`` words of them and they become a segment. Documents added again replace those of the same id;
    deleted ones are left out by an anti join until a merge drops them. Merging is by size class, four segments of one
    class at a time."""

    FAN_OUT, MAX_SEGMENTS, MAX_INPUTS, DEAD_PCT = 4, 8, 32, 15
    SEAL_TOKENS = 1 << 20
    FEATURES = ("pending", "impacts")

    def __init__(self, spark: SparkSession, path: str, require_analyzer_match: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        self._open(self._latest())
        if self.meta["min_read"] > FORMAT or set(self.meta["features"]) - set(self.FEATURES):
            raise SearchError("the index was written by a later version", "0A000")
        if self.meta["format"] < OLDEST:
            raise SearchError("the index is of a version that is no longer read; build it again", "0A000")
        if self.meta["fingerprint"] != self.analyzer.fingerprint():
            said = "the index was built by another analyzer; build it again"
            if require_analyzer_match:
                raise SearchError(said, "55000")
            warnings.warn(said, stacklevel=2)

    def _open(self, meta: dict) -> None:
        # what older manifests do not have
        self.meta = {"pending": [], "options": {}, "key_type": "long", "features": [], "min_read": meta["format"]} | meta
        self.fields, self.store_positions, self.key_type = meta["fields"], meta["store_positions"], self.meta["key_type"]
        self.analyzer, self.options = Analyzer(**meta["analyzer"]), self.meta["options"]

    # manifests

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        p, fs = self._fs()
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(p, "manifest-*/_SUCCESS"))
        return sorted(x.getPath().getParent().getName() for x in done or [])

    def _read(self, manifest: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/{manifest}").collect()))

    def _latest(self) -> dict:
        found = self._manifests()
        if not found:
            raise SearchError(f"no index at {self.path}", "42P01")
        return self._read(found[-1])

    def _publish(self, **changes) -> None:
        self.meta = self.meta | changes | {"version": self.meta["version"] + 1}
        self.spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.meta['version']:08d}")
        self.__dict__.pop("field_stats", None)

    @classmethod
    def build(cls, df: DataFrame, doc_id: str, fields: list[str], path: str | None = None, analyzer: Analyzer = Analyzer(), store_positions: bool = True, **options) -> Index:
        """options: those of Ranking, kept with the index and used unless a query gives its own."""
        from marginalia.operators.search import Ranking

        Ranking(**options).check(fields)
        spark = df.sparkSession
        self = cls.__new__(cls)
        self.spark, self.path = spark, (path or folder_for(spark, "index")).rstrip("/")
        self._open({"version": 0, "format": FORMAT, "min_read": FORMAT, "features": list(cls.FEATURES), "fields": fields, "store_positions": store_positions, "fingerprint": analyzer.fingerprint(), "segments": [], "deletes": [], "pending": [], "options": options, "key_type": key_type_of(df, doc_id), "analyzer": {"stop_words": analyzer.stop_words, "stemming": analyzer.stemming}})
        name, n_docs, _ = self._forward(Scan(df, doc_id, fields, analyzer, store_positions))
        self._publish(segments=[self._segment(self._forwards([name]), n_docs)])
        self._remove([name])
        return self

    # segments

    def _remove(self, names: list[str]) -> int:
        p, fs = self._fs()
        return sum(fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p, x), True) for x in names)

    def _forward(self, source: Scan) -> tuple[str, int, int]:
        """Analyze documents once: name of what was written, its documents and words."""
        name = f"forward-{uuid.uuid4().hex}"
        source.forward().write.parquet(f"{self.path}/{name}")
        words = F.aggregate("dls", F.lit(0), lambda a, x: a + x)
        n, most, total = self._forwards([name]).agg(F.count(F.lit(1)), F.max(words), F.sum(words.cast("long"))).first()
        if (most or 0) > MAX_TOKENS:
            self._remove([name])
            raise SearchError(f"a document has more than {MAX_TOKENS} words", "54000")
        return name, n, total or 0

    def _forwards(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(forward_schema(self.key_type)).parquet(*[f"{self.path}/{x}" for x in names])

    def _segment(self, forward: DataFrame, n_docs: int) -> dict:
        """Write the segment of documents in the form of forward()."""
        lengths = forward.select("doc_id", "dls")
        return self._write(inverted(forward, self.store_positions), lengths, n_docs)

    def _write(self, postings: DataFrame, lengths: DataFrame, n_docs: int | None = None) -> dict:
        name = f"segment-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        lengths.write.parquet(f"{at}/lengths")
        # the order within files lets the reader skip pages without the terms or blocks asked for; ranges over all of
        # it deal a frequent term out to many files
        order = ["term", "field_id", "block", "doc_id"]
        postings.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{at}/postings")
        rows = self.spark.read.schema(postings_schema(self.key_type)).parquet(f"{at}/postings").groupBy("term", "field_id", "block")
        rows.agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")).sortWithinPartitions("term").write.parquet(f"{at}/impacts")
        if n_docs is None:
            n_docs = self.spark.read.parquet(f"{at}/lengths").count()
        return {"name": name, "n_docs": n_docs, "born": self.meta["version"], "format": FORMAT}

    def _gone(self, born: int) -> DataFrame | None:
        names = [d["name"] for d in self.meta["deletes"] if d["at"] > born]
        return self.spark.read.schema(f"doc_id {self.key_type}").parquet(*[f"{self.path}/{d}" for d in names]) if names else None

    def _without(self, rows: DataFrame, born: int) -> DataFrame:
        """Rows without those of documents that a deletion later than born hides. Whole numbers that were deleted are
        kept as bits of 64 together, so that many fit a broadcast; more are joined as they are."""
        gone = self._gone(born)
        if gone is None:
            return rows
        if self.key_type == "long":
            bits = gone.groupBy(F.shiftright("doc_id", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc_id & 63 AS int))")).alias("__bits"))
            key = tuple(d["name"] for d in self.meta["deletes"] if d["at"] > born)
            counts = self.__dict__.setdefault("_bit_rows", {})
            if key not in counts:
                counts[key] = bits.count()
            if counts[key] <= BROADCAST_BITS:
                on = rows.withColumn("__word", F.shiftright("doc_id", 6)).join(F.broadcast(bits), "__word", "left")
                dead = F.expr("coalesce(shiftright(__bits, cast(doc_id & 63 AS int)) & 1L, 0L) = 1L")
                return on.where(~dead).select(*rows.columns)
        return rows.join(gone, "doc_id", "left_anti")

    def _live(self, part: str, schema: str, where: Column | None, pending) -> DataFrame:
        """Rows of all segments and of what is pending, without those that a later deletion or a later version of the
        document hides. pending: what to make of rows of forward()."""
        out = []
        for s in self.meta["segments"]:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}/{part}")
            out.append((s, rows if where is None else rows.where(where)))
        # of what is pending, documents are left out before they are taken apart
        out += [(s, pending(self._without(self._forwards([s["name"]]), s["born"]))) for s in self.meta["pending"]]
        found = []
        for k, (s, rows) in enumerate(out):
            if "block long" in schema:  # blocks count from the start in each segment
                rows = rows.withColumn("block", F.struct(F.lit(s["name"]).alias("segment"), "block"))
            found.append(self._without(rows, s["born"]) if k < len(self.meta["segments"]) and "doc_id" in rows.columns else rows)
        return reduce(DataFrame.unionByName, found)

    def _all_postings(self, terms: list[str] | None, where: Column | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
        if terms is not None:
            some = chosen(F.col("term"), terms, patterns)
            where = some if where is None else where & some
        rows = self._live("postings", postings_schema(self.key_type), where, lambda f: inverted(f, self.store_positions, terms, patterns))
        return rows.select(*POSTING, "block")

    def postings(self, terms: list[str] | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
        return self._all_postings(terms, None, patterns).select(*POSTING)

    def vocabulary(self, head: str = "") -> DataFrame:
        rows = self._live("postings", postings_schema(self.key_type), F.col("term").startswith(head), lambda f: inverted(f, self.store_positions).where(F.col("term").startswith(head)))
        return rows.select("term").distinct()

    def lengths(self) -> DataFrame:
        return self._live("lengths", f"doc_id {self.key_type}, dls array<int>", None, lambda f: f.select("doc_id", "dls"))

    def impacts(self, terms: list[str] | None = None, size: int = BLOCK) -> DataFrame:
        """As stored: deleted documents may still raise a bound. Pending ones are computed."""
        def summed(rows):
            return rows.groupBy("term", "field_id", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))

        if self._without_blocks:
            return summed(self._all_postings(terms))
        schema = "term string, field_id int, block long, n long, max_tf int, min_dl int"
        return self._live("impacts", schema, None if terms is None else F.col("term").isin(list(terms)), lambda f: summed(inverted(f, self.store_positions, terms)))

    def in_blocks(self, terms: list[str], blocks: DataFrame, size: int = BLOCK) -> DataFrame:
        """Postings of the terms in blocks of impacts(); few blocks reach the Parquet reader, which skips the others."""
        some = [] if self._without_blocks else blocks.limit(MANY_BLOCKS + 1).collect()
        if self._without_blocks or len(some) > MANY_BLOCKS:
            return self._all_postings(terms).join(blocks, "block", "left_semi").select(*POSTING)
        numbers = F.col("block").isin([r.block["block"] for r in some])
        chosen = self.spark.createDataFrame(some, blocks.schema)
        return self._all_postings(terms, numbers).join(F.broadcast(chosen), "block", "left_semi").select(*POSTING)

    # changes

    def _same_key(self, df: DataFrame, doc_id: str) -> None:
        if key_type_of(df, doc_id) != self.key_type:
            raise SearchError(f'the index has keys of type {self.key_type}, "{doc_id}" is of another', "42804")

    def add(self, df: DataFrame, doc_id: str, seal_tokens: int | None = None) -> None:
        """Documents, visible at once; those whose ids the index has already are replaced. What is pending becomes a
        segment once it has ``seal_tokens`` words."""
        self._same_key(df, doc_id)
        new, n_docs, words = self._forward(Scan(df, doc_id, self.fields, self.analyzer, self.store_positions))
        name = self._delete_rows(df.select(F.col(doc_id).cast(self.key_type).alias("doc_id")))
        at = self.meta["version"]
        self._publish(pending=[*self.meta["pending"], {"name": new, "n_docs": n_docs, "n_words": words, "born": at + 1}], deletes=[*self.meta["deletes"], {"name": name, "at": at + 1}])
        if sum(x["n_words"] for x in self.meta["pending"]) >= (self.SEAL_TOKENS if seal_tokens is None else seal_tokens):
            self.seal()

    def seal(self) -> int:
        """Make one segment of what is pending; returns its documents."""
        if not self.meta["pending"]:
            return 0
        part = self._of([], self.meta["pending"])
        forward = part._live("none", "none", None, lambda f: f)
        segment = self._segment(forward, None)
        # its dead documents are gone already, so that deletes up to now need not look at it again
        self._publish(segments=[*self.meta["segments"], segment | {"born": self.meta["version"]}], pending=[])
        return segment["n_docs"]

    def _delete_rows(self, ids: DataFrame) -> str:
        name = f"deletes-{uuid.uuid4().hex}"
        ids.distinct().write.parquet(f"{self.path}/{name}")
        return name

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        self._same_key(ids, doc_id)
        name = self._delete_rows(ids.select(F.col(doc_id).cast(self.key_type).alias("doc_id")))
        self._publish(deletes=[*self.meta["deletes"], {"name": name, "at": self.meta["version"] + 1}])

    def merge(self, force: bool = False) -> int:
        """Rewrite the segments that the policy picks (force: all) as one, without dead documents; returns how many."""
        counts = {s["name"]: s["n_docs"] for s in self.meta["segments"]}
        dead = {s["name"]: s["n_docs"] - self._of([s]).lengths().count() for s in self.meta["segments"]} if self.meta["deletes"] and not force else {}
        picked = list(counts) if force else pick(counts, dead, self.FAN_OUT, self.MAX_SEGMENTS, self.MAX_INPUTS, self.DEAD_PCT)
        return self._rewrite(picked)

    def _rewrite(self, picked: list[str]) -> int:
        chosen = [s for s in self.meta["segments"] if s["name"] in picked]
        if not chosen:
            return 0
        part = self._of(chosen)
        # blocks of several segments get numbers of their own; those of documents without one, by the id
        number = F.pmod(F.xxhash64("block.segment", F.coalesce(F.col("block.block"), F.xxhash64("doc_id") % 65_536)), F.lit(1 << 62))
        new = self._write(part._all_postings(None).withColumn("block", number), part.lengths())
        rest = [s for s in self.meta["segments"] if s["name"] not in picked]
        oldest = min((s["born"] for s in [*rest, *self.meta["pending"]]), default=self.meta["version"] + 1)
        deletes = [d for d in self.meta["deletes"] if d["at"] > oldest]
        self._publish(segments=[*rest, new | {"born": self.meta["version"]}], deletes=deletes)
        return len(chosen)

    @property
    def _without_blocks(self) -> bool:
        return any(s.get("format", 1) < 2 for s in self.meta["segments"])

    @property
    def counts_live(self) -> bool:
        return not self.meta["deletes"]

    def _of(self, segments: list[dict], pending: list[dict] = ()) -> Index:
        part = Index.__new__(Index)
        part.__dict__ |= {k: v for k, v in self.__dict__.items() if k != "field_stats"}
        part.meta = self.meta | {"segments": segments, "pending": list(pending)}
        return part

    def upgrade(self) -> str:
        """Seal, and write segments of older versions anew."""
        self.seal()
        old = [s for s in self.meta["segments"] if s.get("format", 1) < FORMAT]
        if not old and self.meta["format"] == FORMAT:
            return f"already current (v{FORMAT})"
        before = min(s.get("format", 1) for s in old) if old else self.meta["format"]
        for s in old:
            self._rewrite([s["name"]])
        self._publish(format=FORMAT, min_read=FORMAT, features=list(self.FEATURES))
        return f"upgraded {len(old)} segments: v{before} -> v{FORMAT}"

    def vacuum(self, keep: int = 1) -> int:
        """Seal, merge, then remove the folders that none of the newest ``keep`` manifests names: readers of older ones
        must have ended."""
        self.seal()
        self.merge()
        p, fs = self._fs()
        newest = self._manifests()[-keep:]
        named = set(newest)
        for m in map(self._read, newest):
            named |= {x["name"] for part in ("segments", "deletes", "pending") for x in m.get(part, ())}
        return self._remove([x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName() not in named])

    def stats(self) -> DataFrame:
        """One row about the index."""
        total = F.coalesce(F.sum(F.aggregate("dls", F.lit(0), lambda a, x: a + x).cast("long")), F.lit(0))
        lens = self.lengths().agg(F.count(F.lit(1)).alias("n_docs"), total.alias("total_len"))
        sealed = self._of(self.meta["segments"]).lengths() if self.meta["segments"] else None
        average = None if sealed is None else sealed.agg(F.coalesce(F.try_divide(total, F.count(F.lit(1))), F.lit(1.0))).first()[0]
        more = {"n_segments": len(self.meta["segments"]), "n_deletes": len(self.meta["deletes"]), "pending_docs": sum(x["n_docs"] for x in self.meta["pending"]), "k1": float(self.options.get("k1", 1.2)), "b": float(self.options.get("b", 0.75)), "sealed_avg_len": average, "format_version": self.meta["format"], "min_read_version": self.meta["min_read"], "features": ",".join(self.meta["features"]), "fingerprint": self.meta["fingerprint"], "n_fields": len(self.fields), "key_type": self.key_type}
        return lens.select("*", *[F.lit(v).alias(k) for k, v in more.items()])

    def segments(self) -> DataFrame:
        """A row a segment: name, documents written and alive, words alive, postings, terms."""
        rows = None
        for s in self.meta["segments"]:
            part = self._of([s])
            total = F.coalesce(F.sum(F.aggregate("dls", F.lit(0), lambda a, x: a + x).cast("long")), F.lit(0))
            named = F.lit(s["name"]).alias("segment")
            one = part.lengths().agg(F.count(F.lit(1)).alias("n_live"), total.alias("total_len")).select(named, F.lit(s["n_docs"]).cast("long").alias("n_docs"), "*")
            one = one.join(part.postings().agg(F.count(F.lit(1)).alias("n_postings"), F.count_distinct("term").alias("n_terms")).select(named, "*"), "segment")
            rows = one if rows is None else rows.unionByName(one)
        return rows if rows is not None else self.spark.createDataFrame([], "segment string, n_docs long, n_live long, total_len long, n_postings long, n_terms long")


#: Rows of 64 deleted ids each that are broadcast, about 40 MB.
BROADCAST_BITS = 500_000
#: Blocks that are named in the filter of a scan; more are joined.
MANY_BLOCKS = 2_000


def pick(n_docs: dict[str, int], dead: dict[str, int], fan_out: int = 4, most: int = 8, inputs: int = 32, dead_pct: int = 15) -> list[str]:
    """Segments to merge. Those with many dead documents first; else the largest size class that has fan_out members;
    else, of too many segments, the two smallest."""
    by_size = sorted(n_docs, key=lambda s: (n_docs[s], s))
    rotten = [s for s in by_size if n_docs[s] and 100 * dead.get(s, 0) >= dead_pct * n_docs[s]]
    if rotten:
        return rotten[:inputs]
    classes: dict[int, list[str]] = {}
    for s in by_size:
        level = 0
        while 4 ** (level + 1) <= n_docs[s]:
            level += 1
        classes.setdefault(level, []).append(s)
    full = [c for c in classes if len(classes[c]) >= fan_out]
    if full:
        return classes[max(full, key=lambda c: (len(classes[c]), -c))][:inputs]
    return by_size[:2] if len(by_size) > most else []
