"""A segment: the tables of an index over one set of documents, built lazily or read from storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.analyze import BLOCK_INPUT, BLOCKS, blocks, blocks_of, counted, tokens, unfold
from lodestone.sources.arrange import arranged
from lodestone.sources.mapping import FLAGS, ID, FieldSpec, Mapping

FORMAT, KIND = 1, "lodestone"
SCHEMAS = {
    "docs": "doc_num long, id string, parent long",
    "fields_meta": "field string, indexed boolean, stored boolean, doc_values boolean, term_vectors boolean",
    "postings": "field string, term string, doc_num long, freq long, field_len long, locations array<struct<field:string,pos:bigint,start:bigint,end:bigint,array_pos:array<bigint>>>",
    "doc_values": "doc_num long, field string, terms array<string>, extra binary",
    "stored": "doc_num long, field string, seq int, typ string, value binary, array_pos array<long>",
    "vectors": "field string, vec_id long, doc_num long, embedding array<float>, centroid long, codes array<int>",
    "centroids": "field string, centroid long, embedding array<double>",
    "vector_meta": "field string, kind string, metric string, optimise string, n long, dim int, lows array<double>, steps array<double>",
    "synonyms": "thesaurus string, term string, synonym string, doc_num long",
    "dictionary": "field string, term string, df long, single boolean",
    "updates": "field string, deleted boolean, no_index boolean, no_store boolean, no_doc_values boolean",
}
PARTITIONS = {"vectors": ["field", "centroid"]}
CLEAR = ("field", "thesaurus", "doc_num", "centroid")  # columns that a hook leaves alone, so that files can be pruned by them
IN_CLEAR = ("fields_meta", "vector_meta", "updates")
VECTOR_BITS = 20  # of a vec_id, for the ordinal within a document


@dataclass
class Hook:
    """Transforms the payload of all tables on its way to and from storage; its id goes into the manifest. ``write`` and
    ``read`` take the bytes and the secret, a column that comes from a table of one row: no plan or log shows it."""

    id: str
    write: Callable[[Column, Column], Column]
    read: Callable[[Column, Column], Column]
    secret: bytes = b""

    def _with_secret(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(bytearray(self.secret),)], "_secret binary")))

    def seal(self, df: DataFrame) -> DataFrame:
        """Columns beyond CLEAR as one sealed column."""
        clear = [c for c in df.columns if c in CLEAR]
        payload = F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in CLEAR])).cast("binary")
        return self._with_secret(df).select(*clear, self.write(payload, F.col("_secret")).alias("payload"))

    def unseal(self, df: DataFrame, schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        every = StructType.fromDDL(schema)
        inner = StructType([f for f in every.fields if f.name not in CLEAR])
        opened = self._with_secret(df).withColumn("payload", F.from_json(self.read(F.col("payload"), F.col("_secret")).cast("string"), inner))
        return opened.select(*[F.col(f.name) if f.name in CLEAR else F.col(f"payload.{f.name}") for f in every.fields])


def aes_hook(hook_id: str, key: str) -> Hook:
    """AES-GCM with a 16, 24 or 32 byte key given in hexadecimal."""
    return Hook(hook_id, lambda c, k: F.aes_encrypt(c, k, F.lit("GCM")), lambda c, k: F.aes_decrypt(c, k, F.lit("GCM")), bytes.fromhex(key))


class Segment:
    """Lazy tables named as in SCHEMAS. ``tables`` may hold any subset; absent ones are empty. ``shared``: what several
    tables are made of, kept while they are written. ``blocks``: the postings in blocks, which are sorted and stored in
    place of their rows. ``raw``: rows and names of sources that blocks are yet to be made of."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], manifest: dict | None = None, shared: tuple[DataFrame, ...] = (), blocks: DataFrame | None = None, raw: tuple[DataFrame, tuple[str, ...]] | None = None):
        self.spark, self._tables, self.manifest, self.shared, self.blocks, self.raw = spark, tables, manifest or {}, shared, blocks, raw

    def has(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str) -> DataFrame:
        if name == "dictionary" and not self.has(name) and self.has("postings"):
            return entries(self.postings if self.blocks is None else self.blocks)
        return self._tables[name] if name in self._tables else self.spark.createDataFrame([], SCHEMAS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    def replace(self, **tables: DataFrame) -> Segment:
        return Segment(self.spark, self._tables | tables, self.manifest, self.shared, *((None, None) if "postings" in tables else (self.blocks, self.raw)))

    @property
    def edges(self) -> DataFrame:
        return self.docs.filter("parent is not null").select(F.col("doc_num").alias("child"), "parent")

    def persist(self, path: str, hook: Hook | None = None, overwrite: bool = False) -> str:
        """Write all tables beside the target, then swap by renaming: a failed write or swap leaves what was there.

        Postings and dictionary are ranged and sorted by (field, term), postings of one term further by document (blocks, which
        lie in a folder of their own, by their first), so lookups prune row groups and a frequent term is no single task's; vectors lie in a folder for each field and centroid. The table ``sizes`` tells rows and bytes of each."""
        fs = _filesystem(self.spark, path)
        target, temp = _path(self.spark, path), f"{path}.{uuid.uuid4().hex}.tmp"
        if fs.exists(target) and not overwrite:
            raise FileExistsError(path)
        kept = [df.persist(StorageLevel.DISK_ONLY) for df in self.shared]
        try:
            counts = []
            for name in SCHEMAS:
                if not (self.has(name) or name in ("docs", "dictionary")):
                    continue
                in_blocks = name == "postings" and self.blocks is not None
                df = (self.blocks if hook else self._arranged()) if in_blocks else self.table(name)
                if name == "dictionary" and not hook and self.has("postings"):
                    df = entries(self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{temp}/postings") if self.blocks is None else self.spark.read.schema(BLOCKS).parquet(f"{temp}/blocks"))
                counts.append((name, *_written(df, name, f"{temp}/{'blocks' if in_blocks else name}", hook)))
            n_docs = next(rows for name, rows, *_ in counts if name == "docs")
            self.spark.createDataFrame(counts, "name string, rows long, bytes long").coalesce(1).write.parquet(f"{temp}/sizes")
            self.spark.createDataFrame([(KIND, FORMAT, n_docs, hook.id if hook else "")], "kind string, format int, num_docs long, hook string").coalesce(1).write.parquet(f"{temp}/manifest")
            _swap(fs, _path(self.spark, temp), target, _path(self.spark, f"{path}.{uuid.uuid4().hex}.old"))
        except BaseException:
            fs.delete(_path(self.spark, temp), True)
            raise
        finally:
            for df in kept:
                df.unpersist()
        return path

    def _arranged(self) -> DataFrame:
        if self.raw is None:
            return arranged(self.blocks, iter, F.size("docs") * F.lit(8))
        rows, sources = self.raw
        return arranged(rows.select(*BLOCK_INPUT), blocks_of(sources), F.aggregate("inst", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["value"])))

    def cache(self) -> Segment:
        return Segment(self.spark, {k: v.persist() for k, v in self._tables.items()}, self.manifest)

    def close(self) -> None:
        for df in self._tables.values():
            df.unpersist()


def entries(postings: DataFrame) -> DataFrame:
    """The dictionary: (field, term, df, single); single marks terms of one document with frequency 1."""
    df, freq = (F.sum(F.size("docs")), F.array_max("freqs")) if "docs" in postings.columns else (F.count("*"), F.col("freq"))
    return postings.groupBy("field", "term").agg(df.alias("df"), ((df == 1) & (F.max(freq) == 1)).alias("single"))


def _written(df: DataFrame, name: str, path: str, hook: Hook | None) -> tuple[int, int]:
    """Write a table; its rows, from the footers, and bytes."""
    postings, seen = F.sum(F.size("docs")).alias("n") if "docs" in df.columns else None, Observation()
    if postings is not None and hook:  # sealed blocks tell no sizes; they are written as they are made, so they are seen once
        df = df.observe(seen, postings)
    if hook and name not in IN_CLEAR:
        df = hook.seal(df)
    if "term" in df.columns and "field" in df.columns and postings is None:
        order = ["field", "term", *(["doc_num"] if "doc_num" in df.columns else [])]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = df.schema
    (df.write.partitionBy(*PARTITIONS[name]) if name in PARTITIONS else df.write).parquet(path)
    spark = df.sparkSession
    back = spark.read.schema(schema).parquet(path)
    rows = back.count() if postings is None else (seen.get["n"] if hook else back.agg(postings).first()["n"]) or 0
    return rows, _filesystem(spark, path).getContentSummary(_path(spark, path)).getLength()


def _swap(fs, new, target, aside) -> None:
    """Put ``new`` in the place of ``target``. If that fails, what was there is put back."""
    old = fs.exists(target)
    if old and not fs.rename(target, aside):
        raise OSError(f"could not move {target} aside")
    try:
        if not fs.rename(new, target):
            raise OSError(f"could not move {new} to {target}")
    except BaseException:
        if old:
            fs.rename(aside, target)
        raise
    if old:
        fs.delete(aside, True)


def _path(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark, path):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def open_segment(spark: SparkSession, path: str, hooks: dict[str, Hook] | None = None) -> Segment:
    """Lazy tables of a written segment; refuses another format version or an unknown hook."""
    m = spark.read.parquet(f"{path}/manifest").first().asDict()
    if m["kind"] != KIND or m["format"] != FORMAT:
        raise ValueError(f"{path} has format {m['kind']} {m['format']}, not {KIND} {FORMAT}")
    hook = (hooks or {}).get(m["hook"])
    if m["hook"] and hook is None:
        raise ValueError(f"{path} was written with the unknown hook {m['hook']!r}")
    fs, tables = _filesystem(spark, path), {}
    for name, schema in SCHEMAS.items():
        if fs.exists(_path(spark, f"{path}/{name}")):
            sealed = hook and name not in IN_CLEAR
            t = spark.read.schema(_sealed(schema) if sealed else schema).parquet(f"{path}/{name}")
            tables[name] = hook.unseal(t, schema) if sealed else t
    folded = None
    if fs.exists(_path(spark, f"{path}/blocks")):
        t = spark.read.schema(_sealed(BLOCKS) if hook else BLOCKS).parquet(f"{path}/blocks")
        folded = hook.unseal(t, BLOCKS) if hook else t
        tables["postings"] = unfold(folded)
    return Segment(spark, tables, m | {"path": path}, blocks=folded)


def _sealed(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields if f.name in CLEAR] + ["payload binary"])


def rewrite(spark: SparkSession, path: str, target: str, hooks: dict[str, Hook] | None = None, hook: Hook | None = None) -> str:
    """Write a segment again through another hook, or none."""
    return open_segment(spark, path, hooks).persist(target, hook)


def _instances(spec: FieldSpec, is_array: bool, src: str) -> Column:
    value = F.expr(spec.expr)
    one = lambda v, at: F.struct(F.lit(src).alias("src"), v.cast("string").alias("value"), at.alias("array_pos"), F.lit(spec.kind == "keyword").alias("keyword"))
    none = F.array().cast("array<long>")
    made = F.transform(value, lambda v, i: one(v, F.array(i.cast("long")))) if is_array else F.array(one(value, none))
    return F.filter(made, lambda x: x["value"].isNotNull())


@dataclass
class Builder:
    """Tables of a segment from rows with ``doc_num`` (dense from 0) and the columns that the mapping names."""

    rows: DataFrame
    mapping: Mapping
    checks: tuple[Callable[[DataFrame], DataFrame], ...] = field(default_factory=tuple)
    unique: bool = False  # no doc_num repeats, so postings of different rows are never one

    @cached_property
    def source(self) -> DataFrame:
        rows = self.rows
        for check in self.checks:
            rows = check(rows)
        if self.mapping.path_expr:
            from lodestone.operators.nested import flatten

            return flatten(rows.withColumn("path", F.expr(self.mapping.path_expr)))
        return rows

    @cached_property
    def per_field(self) -> DataFrame:
        """(doc_num, field, inst, flags...), one row for each field that a document has."""
        rows = self.source
        arrays = dict(rows.select(*[F.expr(f.expr).alias(f"x{i}") for i, f in enumerate(self.mapping.texts)]).dtypes) if self.mapping.texts else {}
        made = {}
        for i, f in enumerate(self.mapping.texts):
            inst = _instances(f, arrays[f"x{i}"].startswith("array"), f.name)
            made.setdefault(f.name, []).append((f, inst))
        id_spec = FieldSpec(ID, self.mapping.id_expr, "keyword", stored=True, term_vectors=False)
        made = {ID: [(id_spec, _instances(id_spec, False, ID))]} | made
        columns, structs = {}, []
        for name, members in made.items():
            inst = members[0][1] if len(members) == 1 else F.concat(*[x for _, x in members])
            extra = F.coalesce(*[F.expr(f.extra).cast("binary") for f, _ in members if f.extra], F.lit(None).cast("binary"))
            columns[name] = (inst, {flag: any(getattr(f, flag) for f, _ in members) for flag in FLAGS}, extra)
        for name, sources in self.mapping.composites.items():
            chosen = sources or tuple(n for n in made if n != ID)
            columns[name] = (F.concat(*[columns[n][0] for n in chosen]), {"indexed": True, "stored": False, "doc_values": False, "term_vectors": True}, F.lit(None).cast("binary"))
        for name, (inst, flags, extra) in columns.items():
            structs.append(F.struct(F.lit(name).alias("field"), inst.alias("inst"), extra.alias("extra"), *[F.lit(v).alias(k) for k, v in flags.items()]))
        wide = rows.select("doc_num", F.explode(F.array(*structs)).alias("f")).select("doc_num", "f.*").filter(F.size("inst") > 0)
        return wide.select("doc_num", "field", "inst", "extra", *FLAGS)

    def docs(self) -> DataFrame:
        parent = F.expr(self.mapping.parent_expr) if self.mapping.parent_expr else F.col("parent") if self.mapping.path_expr else F.lit(None)
        return self.source.select("doc_num", F.expr(self.mapping.id_expr).cast("string").alias("id"), parent.cast("long").alias("parent"))

    def fields_meta(self) -> DataFrame:
        return self.per_field.groupBy("field").agg(*[F.bool_or(flag).alias(flag) for flag in FLAGS])

    def terms(self) -> DataFrame:
        """Postings without locations, counted where the text is read; nothing is shuffled unless a doc_num may repeat."""
        t = counted(self.per_field.filter("indexed"))
        return t if self.unique else t.groupBy("field", "term", "doc_num").agg(F.sum("freq").alias("freq"), F.max("field_len").alias("field_len"))

    @cached_property
    def blocks(self) -> DataFrame:
        return blocks(*self.raw)

    @property
    def raw(self) -> tuple[DataFrame, tuple[str, ...]]:
        return self.per_field.filter("indexed"), self.names

    @property
    def names(self) -> tuple[str, ...]:
        return (ID, *dict.fromkeys(f.name for f in self.mapping.texts))

    def postings(self) -> DataFrame:
        t = unfold(self.blocks)
        if self.unique:
            return t
        places = F.when(F.count("locations") > 0, F.sort_array(F.flatten(F.collect_list("locations"))))
        return t.groupBy("field", "term", "doc_num").agg(F.sum("freq").alias("freq"), F.max("field_len").alias("field_len"), places.alias("locations"))

    def doc_values(self) -> DataFrame:
        """Sorted distinct terms of each (document, field), within the row."""
        each = F.transform("inst", lambda x: F.when(x["keyword"], F.array(x["value"])).otherwise(tokens(x["value"])))
        return self.per_field.filter("doc_values").select("doc_num", "field", F.array_sort(F.array_distinct(F.flatten(each))).alias("terms"), "extra")

    def stored(self) -> DataFrame:
        types = F.create_map(*[F.lit(x) for f in (*self.mapping.texts, FieldSpec(ID, ID)) for x in (f.name, f.typ)])
        x = self.per_field.filter("stored").select("doc_num", "field", F.posexplode("inst").alias("seq", "i"))
        return x.select("doc_num", "field", "seq", F.element_at(types, F.col("field")).alias("typ"), F.col("i.value").cast("binary").alias("value"), "i.array_pos")

    def vectors(self) -> DataFrame | None:
        """One row a vector; an array of arrays gives several to a document. ids follow (doc_num, ordinal)."""
        parts = []
        for f in self.mapping.of("vector"):
            v = self.source.select("doc_num", F.expr(f.expr).alias("v")).filter("v is not null")
            nested = dict(v.dtypes)["v"].startswith("array<array")
            e = v.select("doc_num", F.posexplode("v" if nested else F.array("v")).alias("at", "embedding")).filter(F.size("embedding") > 0)
            parts.append(e.select(F.lit(f.name).alias("field"), vec_ids(F.col("doc_num"), F.col("at")).alias("vec_id"), "doc_num", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(None).cast("long").alias("centroid"), F.lit(None).cast("array<int>").alias("codes")))
        return _union(parts)

    def synonyms(self) -> DataFrame | None:
        """Equivalence sets map each word to the others, one-way rules every term to every synonym; no empty words."""
        parts = []
        for f in self.mapping.of("synonym"):
            s = self.source.select("doc_num", F.expr(f.expr).alias("s")).filter("s is not null")
            one_way = dict(s.dtypes)["s"].startswith("struct")
            pairs = s.select("doc_num", F.explode("s.terms" if one_way else "s").alias("term"), F.col("s.synonyms" if one_way else "s").alias("w")).select("doc_num", "term", F.explode("w").alias("synonym"))
            pairs = pairs.filter("term <> '' and synonym <> ''" + ("" if one_way else " and term <> synonym"))
            parts.append(pairs.select(F.lit(f.name).alias("thesaurus"), "term", "synonym", "doc_num").distinct())
        return _union(parts)

    def segment(self, locations: bool = True) -> Segment:
        """All tables that the registered sections build."""
        from lodestone.operators.sections import REGISTRY

        tables = {"docs": self.docs(), "fields_meta": self.fields_meta()}
        for name, section in REGISTRY.items():
            if self.mapping.claimed(section.claims):
                made = self.terms().withColumn("locations", F.lit(None)) if name == "postings" and not locations else section.build(self)
                if made is not None:
                    tables[name] = made
        folded = self.blocks if self.unique and locations and "postings" in tables else None
        return Segment(self.source.sparkSession, tables, shared=(self.per_field,), blocks=folded, raw=None if folded is None else self.raw)


def vec_ids(doc_num: Column, ordinal: Column) -> Column:
    """Ids in the order of (doc_num, ordinal); more than 2**20 vectors of a document are refused."""
    fits = F.when(ordinal < (1 << VECTOR_BITS), ordinal).otherwise(F.raise_error(F.lit("a document has more than 2**20 vectors")).cast("int"))
    return F.shiftleft(doc_num, VECTOR_BITS) + fits


def _union(parts):
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def build_segment(rows: DataFrame, mapping: Mapping, locations: bool = True, checks=(), unique: bool = False) -> Segment:
    """Segment of rows that carry ``doc_num``; see :func:`number` for rows that don't. ``unique``: no doc_num repeats."""
    return Builder(rows, mapping, tuple(checks), unique).segment(locations)


def is_unique(rows: DataFrame, column: str = "doc_num") -> bool:
    return rows.groupBy(column).count().filter("count > 1").isEmpty()


def spread(rows: DataFrame, least: int = 4096) -> DataFrame:
    """A table read from few or small files, dealt out to all cores: what is made of a row outweighs it by far. Rows go by
    a hash of ``doc_num``, if they have one: dealt out in turn, a task would first sort all that it reads, the whole table if it is one file."""
    have, want = rows._jdf.queryExecution().toRdd().getNumPartitions(), 2 * rows.sparkSession.sparkContext.defaultParallelism
    want = want if have >= want else min(want, -(-rows.count() // least))
    return rows.repartition(want, *(["doc_num"] if "doc_num" in rows.columns else rows.columns)) if have < want else rows


def dense(rows: DataFrame, scope: list[str], old: str, new: str, width: int = 1 << 16) -> DataFrame:
    """Dense numbers from 0 in the order of the integer column ``old`` within ``scope``: buckets of ``width`` values are
    numbered on their own and shifted by the sums of those before, so no task sees a whole scope."""
    b = rows.withColumn("_bucket", F.floor(F.col(old) / width).cast("long"))
    counts = b.groupBy(*scope, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*scope, "_bucket").orderBy(old)) - 1
    return b.withColumn("_own", own).join(before, [*scope, "_bucket"]).withColumn(new, F.col("_shift") + F.col("_own")).drop("_bucket", "_shift", "_own")


def number(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``doc_num``, dense from 0 in the order of any columns: ranged, sorted, cut once, then shifted by the counts
    of the partitions before."""
    from lodestone.session import materialise

    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    return placed.withColumn("_part", part).join(before, "_part").withColumn("doc_num", F.col("_shift") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_shift")
