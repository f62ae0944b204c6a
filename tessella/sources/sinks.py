"""Sinks: JSON, CSV, GraphML and tables with a manifest."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import SEP
from tessella.sources.files import EDGE_KEYS, NODE_KEYS


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (K1)."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, errors: str) -> None:
    """Results, and those with an error elsewhere."""
    write_json(df.where("error is null").drop("error"), path)
    write_json(df.where("error is not null"), errors)


#: What XML 1.0 cannot hold, even escaped.
_NO_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]"
#: Files that one request to the file system joins.
JOINED = 500
#: Where this is true, Spark deletes what a write shuffled when it ends, not when the driver's memory is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as one GraphML document, with the declarations of its keys.

    Tasks encode and write the elements, in as many parts as the frames have partitions; the file
    system puts the parts together in order between a header and a footer (:func:`join_files`), so
    neither one task nor the driver encodes the graph. The document appears under ``path`` by a
    rename and takes the place of a file of that name. A null text is an empty element; characters
    that XML cannot hold are left out.
    """
    spark = nodes.sparkSession
    legal = lambda value: F.regexp_replace(value.cast("string"), _NO_XML, "")
    datum = lambda key, value: F.struct(F.lit(key).alias("_key"), legal(value).alias("_VALUE"))
    data = lambda keys: F.array(*[datum(k, F.array_join("source_ids", SEP) if name == "source_id" else F.col(name)) for k, name in keys.items()]).alias("data")
    # one line for each element, line ends in texts as references, so that readers can cut the document anywhere
    xml = lambda tag, *fields: F.rtrim(F.to_xml(F.struct(*fields), {"rowTag": tag, "indent": ""}), F.lit("\n"))
    element = lambda tag, *fields: F.replace(F.replace(xml(tag, *fields), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;")).alias("value")
    n = nodes.select(element("node", legal(F.col("id")).alias("_id"), data(NODE_KEYS)))
    e = edges.select(element("edge", legal(F.col("lo")).alias("_source"), legal(F.col("hi")).alias("_target"), data(EDGE_KEYS)))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for kind, keys in (("node", NODE_KEYS), ("edge", EDGE_KEYS)):
        head += [f'<key id="{k}" for="{kind}" attr.name="{name}" attr.type="{"double" if name == "weight" else "string"}"/>' for k, name in keys.items()]
    head.append('<graph edgedefault="undirected">')

    at = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = at(path), f"{path}.parts-{uuid.uuid4().hex}"
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    with _shuffles_deleted(spark):
        for name, frame in (("nodes", n), ("edges", e)):
            frame.write.text(f"{aside}/{name}")
    for name, lines in (("document", head), ("footer", ["</graph>", "</graphml>"])):
        out = files.create(at(f"{aside}/{name}"))
        try:
            out.write(bytearray("".join(line + "\n" for line in lines).encode()))
        finally:
            out.close()
    parts = [f"{aside}/{folder}/{part}" for folder in ("nodes", "edges") for part in _parts(files, at(f"{aside}/{folder}"))]
    join_files(spark, f"{aside}/document", [*parts, f"{aside}/footer"])
    if files.exists(target):
        files.delete(target, False)  # a file; a folder with content is an error
    if not files.rename(at(f"{aside}/document"), target):
        raise OSError(f"{aside}/document cannot be renamed to {path}")
    files.delete(at(aside), True)


def _parts(files, folder) -> list[str]:
    """Names of the files that tasks wrote into a folder, in order of the partitions."""
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted((x for x in names if x.startswith("part-")), key=lambda x: int(x.split("-")[1]))


def join_files(spark: SparkSession, first: str, others: list[str]) -> None:
    """Append whole files to ``first`` in order, in the file system; ``others`` are gone afterwards.

    A file system with ``concat`` links blocks and moves no bytes. The local one appends the files and
    deletes each as soon as it is appended, so that besides the joined bytes it holds one file twice.
    One that can do neither raises an error, and the parts, which in order are the same bytes, stay.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(first).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.hasPathCapability(at(first), "fs.capability.paths.concat"):
        for k in range(0, len(others), JOINED):
            group = others[k : k + JOINED]
            some = spark.sparkContext._gateway.new_array(at, len(group))
            for i, name in enumerate(group):
                some[i] = at(name)
            files.concat(at(first), some)
        return
    if files.getUri().getScheme() != "file":
        raise NotImplementedError(f"{files.getUri()} cannot join files; the parts of {first} stay")
    local = lambda name: at(name).toUri().getPath()
    with open(local(first), "ab") as out:
        for name in others:
            with open(local(name), "rb") as part:
                shutil.copyfileobj(part, out, 1 << 20)
            out.flush()
            files.delete(at(name), False)
    files.delete(at(first).getParent().suffix(f"/.{at(first).getName()}.crc"), False)  # the checksums of the first file alone


def load_external(df: DataFrame, connect: Callable, batch: int = 500) -> None:
    """Send rows in batches to an external store by an injected connection.

    ``connect()`` runs in each task and returns a function of a list of dicts; writes have to be
    idempotent, as a lost task runs again.
    """

    def send(rows) -> None:
        put, held = connect(), []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) >= batch:
                put(held)
                held = []
        if held:
            put(held)

    df.foreachPartition(send)


#: Tables that a commit writes at a time.
WRITERS = 8


@dataclass(frozen=True)
class Keyed:
    """A table whose rows are put, removed and looked up by a key.

    A row belongs to a bucket by a hash of ``place``, the leading part of ``key`` (all of it by
    default), so a lookup by these columns reads their buckets only. Rows of equal key that were put
    by one commit stand together; a later commit replaces them all. Keys are not null.
    """

    schema: str
    key: tuple[str, ...] = ("id",)
    place: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f.name for f in T.StructType.fromDDL(self.schema).fields]

    @property
    def by(self) -> tuple[str, ...]:
        return self.place or self.key


class Conflict(RuntimeError):
    """Another commit changed a table that this one was made from."""


class TableStore:
    """Parquet tables under one folder; a commit changes several of them, all together.

    A plain table is a list of folders, which a commit replaces or appends to. A :class:`Keyed` table
    is dealt out by buckets: a commit writes only the rows that it puts and marks of the keys that it
    removes, in files of the buckets that these touch. Readers merge such changes into the rows below
    them, and :meth:`compact` rewrites touched buckets once there are ``most`` changes.

    A commit writes its folders first, then a manifest of all tables under a name of its own, which it
    renames to the next free number: readers see the old state or the new one, never a part. A commit
    fails if a table that it touches was changed since ``since``; changes of other tables stay.
    Old folders stay until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str, keyed: dict[str, Keyed] | None = None, buckets: int = 64, most: int = 16):
        self.spark, self.folder, self.keyed, self.most = spark, folder.rstrip("/"), keyed or {}, most
        self.buckets = self._state()[1].get("_buckets", [buckets])[0]  # what the store was made with

    def _files(self, name: str = "_manifest"):
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _state(self) -> tuple[int, dict]:
        """Number of the last commit, and what each table is made of."""
        files, path = self._files()
        if not files.exists(path):
            return 0, {}
        last = max((f.getPath().getName() for f in files.listStatus(path)), default=None)
        if last is None:
            return 0, {}
        stream = files.open(self.spark._jvm.org.apache.hadoop.fs.Path(path, last))
        try:
            return int(last), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def snapshot(self) -> dict:
        """The state that reads from now on may be made from, for ``since`` of a commit."""
        return self._state()[1]

    # writing

    def commit(
        self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, put: dict[str, DataFrame] | None = None, remove: dict[str, DataFrame] | None = None, since: dict | None = None
    ) -> None:
        """Write the given rows, then make them current together.

        ``put`` and ``remove`` are rows and keys of keyed tables; a key in both is put.
        """
        seen = self.snapshot() if since is None else since
        keyed = list({**(put or {}), **(remove or {})})
        replacing = [lambda n=n, df=df: self._replacing(n, df) for n, df in (replace or {}).items()]
        appending = [lambda n=n, df=df: self._appending(n, df) for n, df in (append or {}).items()]
        changing = [lambda n=n: self._changing(n, (put or {}).get(n), (remove or {}).get(n)) for n in keyed]
        names, makers = [*(replace or {}), *(append or {}), *keyed], [*replacing, *appending, *changing]
        with ThreadPoolExecutor(max(1, min(WRITERS, len(makers)))) as pool:
            made = [f.result() for f in [pool.submit(m) for m in makers]]
        changes = {n: change for n, change in zip(names, made, strict=True) if change}
        if changes:
            self._publish(changes, seen)
        _, state = self._state()
        for name in changes:
            if name in self.keyed and len(state[name]["changes"]) > self.most:
                self.compact(name)

    def _appending(self, name: str, df: DataFrame) -> Callable:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}/{version}")
        return lambda was: [*(was or []), version]

    def _changing(self, name: str, rows: DataFrame | None, gone: DataFrame | None) -> Callable | None:
        version, touched = self._write(name, rows, gone)
        if not touched:
            return None
        return lambda was: {"base": (was or {}).get("base", {}), "changes": [*(was or {}).get("changes", []), [version, touched]]}

    def _replacing(self, name: str, df: DataFrame) -> Callable:
        if name in self.keyed:
            version, touched = self._write(name, df, None)
            return lambda was: {"base": {}, "changes": [[version, touched]] if touched else []}
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}/{version}")
        return lambda was: [version]

    def _write(self, name: str, rows: DataFrame | None, gone: DataFrame | None) -> tuple[str, list[int]]:
        """Write changes of a keyed table; their folder and the buckets that they touch."""
        spec, parts = self.keyed[name], []
        if rows is not None:
            parts.append(rows.select(*spec.columns).withColumn("__gone", F.lit(False)))
        if gone is not None:
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(spec.schema).fields if f.name not in spec.key]
            parts.append(gone.select(*spec.key).distinct().select(*spec.key, *blank).select(*spec.columns).withColumn("__gone", F.lit(True)))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._buckets_written(name, df.withColumn("bucket", self._bucket(spec)))

    def _buckets_written(self, name: str, df: DataFrame) -> tuple[str, list[int]]:
        version = uuid.uuid4().hex
        df.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{version}")
        files, path = self._files(f"{name}/{version}")
        found = [f.getPath().getName() for f in files.listStatus(path)]
        return version, sorted(int(b.removeprefix("bucket=")) for b in found if b.startswith("bucket="))

    def _bucket(self, spec: Keyed) -> Column:
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(spec.schema).fields}
        return F.pmod(F.xxhash64(*[F.col(c).cast(kinds[c]) for c in spec.by]), F.lit(self.buckets)).cast("int")

    def _publish(self, changes: dict[str, Callable], seen: dict) -> None:
        files, folder = self._files()
        _, aside = self._files("_pending")
        for attempt in range(5):
            number, state = self._state()
            changed = [n for n in changes if state.get(n) != seen.get(n)]
            if changed:
                raise Conflict(f"changed by another commit: {', '.join(changed)}")
            new = {**state, **{n: change(state.get(n)) for n, change in changes.items()}, "_buckets": [self.buckets]}
            draft = self.spark._jvm.org.apache.hadoop.fs.Path(aside, uuid.uuid4().hex)
            stream = files.create(draft, False)
            try:
                stream.write(bytearray(json.dumps(new).encode()))
            finally:
                stream.close()
            files.mkdirs(folder)
            try:
                self._renamed(draft, self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number + 1:012d}"))
                return
            except Exception:  # a commit of other tables took the number
                files.delete(draft, False)
                if attempt == 4:
                    raise

    def _renamed(self, draft, final) -> None:
        """Rename without overwriting: it fails if the name exists."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        kinds[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        context.rename(draft, final, kinds)

    def create(self, schemas: dict[str, str]) -> None:
        """Empty tables for names that have none yet; keyed ones need no file."""
        _, known = self._state()
        missing = {n: self.spark.createDataFrame([], s) for n, s in schemas.items() if n not in known}
        if missing:
            self.commit(missing)

    def compact(self, name: str) -> int:
        """Merge a keyed table's changes into the buckets that they touch; how many were rewritten. Other buckets keep their files."""
        seen = self.snapshot()
        own = seen.get(name) or {"base": {}, "changes": []}
        touched = sorted({b for _, buckets in own["changes"] for b in buckets})
        if not touched:
            return 0
        rows = self._merged(name, own, touched)
        version, filled = self._buckets_written(name, rows.withColumn("bucket", self._bucket(self.keyed[name])))
        base = {b: v for b, v in own["base"].items() if int(b) not in touched} | {str(b): version for b in filled}
        self._publish({name: lambda was: {"base": base, "changes": []}}, seen)
        return len(touched)

    # reading

    def read(self, name: str) -> DataFrame:
        """All rows of a table as they are now."""
        _, state = self._state()
        if name in self.keyed:
            return self._merged(name, state.get(name) or {"base": {}, "changes": []})
        return self.spark.read.parquet(*[f"{self.folder}/{name}/{part}" for part in state[name]])

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a keyed table for ``keys``, which have the columns that choose the bucket, or the whole key.

        The buckets of the keys are found first (one number for each comes to the driver), and only
        their files are in the plan.
        """
        spec, state = self.keyed[name], self._state()[1].get(name) or {"base": {}, "changes": []}
        by = list(spec.key) if set(spec.key) <= set(keys.columns) else list(spec.by)
        wanted = keys.select(*by).distinct()
        buckets = [r.bucket for r in wanted.select(self._bucket(spec).alias("bucket")).distinct().collect()]
        return self._merged(name, state, buckets).join(wanted, by, "left_semi").select(*spec.columns)

    def _merged(self, name: str, own: dict, buckets: list[int] | None = None) -> DataFrame:
        spec = self.keyed[name]
        wanted = None if buckets is None else set(buckets)
        at = lambda version, some: [f"{self.folder}/{name}/{version}/bucket={b}" for b in some if wanted is None or int(b) in wanted]
        base = self._parquet(spec.schema, [p for b, version in own["base"].items() for p in at(version, [b])])
        changes = [(seq, at(version, some)) for seq, (version, some) in enumerate(own["changes"])]
        changes = [self._parquet(f"{spec.schema}, __gone boolean", paths).withColumn("__seq", F.lit(seq)) for seq, paths in changes if paths]
        if not changes:
            return base
        every = changes[0]
        for more in changes[1:]:
            every = every.unionByName(more)
        if len(changes) > 1:
            every = every.withColumn("__last", F.max("__seq").over(Window.partitionBy(*spec.key))).where("__seq = __last")
        put = every.where("not __gone").select(*spec.columns)
        if not own["base"]:
            return put
        return base.join(every.select(*spec.key).distinct(), list(spec.key), "left_anti").select(*spec.columns).unionByName(put)

    def _parquet(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # clearing

    def drop(self, *names: str) -> None:
        """Make tables empty, all of them without names."""
        seen = self.snapshot()
        names = names or tuple(n for n in seen if n != "_buckets")
        plain = {n: self._replacing(n, self.read(n).limit(0)) for n in names if n not in self.keyed}
        self._publish({**plain, **{n: lambda was: {"base": {}, "changes": []} for n in names if n in self.keyed}}, seen)

    def vacuum(self) -> int:
        """Delete the folders that no table has now, and all manifests but the last; returns how many folders went.

        Frames that were read before may need them, so no reader may be at work.
        """
        number, state = self._state()
        files, path = self._files()
        gone = 0
        for name, own in state.items():
            parts = {*own["base"].values(), *(v for v, _ in own["changes"])} if isinstance(own, dict) else set(own)
            folder = self._path(name)
            for found in files.listStatus(folder) if name != "_buckets" and files.exists(folder) else []:
                if found.getPath().getName() not in parts:
                    files.delete(found.getPath(), True)
                    gone += 1
        for found in files.listStatus(path):
            if int(found.getPath().getName()) < number:
                files.delete(found.getPath(), False)
        return gone
