"""Snapshots of a triples table: a log of commits over immutable Parquet files.

Layout, all paths relative to the table's folder:

    data/snap=<id>/predicate_part=<first 20 characters>/*.parquet
    deletes/snap=<id>/*.parquet        (triple_hash, predicate)
    _log/<sequence>.json               one commit each
    _log/<sequence>.dropped            marks a commit whose snapshot was deleted
    _refs/<number>.json                tag -> snapshot id; the last one counts

A build writes what is new and deletes what is gone in one commit; data files
come before the log entry. Log entries and references are created exclusively and
never replaced, so of two writers one is told to start again, and readers always
find whole files. A deleted snapshot is hidden; its files stay for those that build
on it. A squashed snapshot names the commits that it stands for and shares their files. A row of snapshot a is seen at s if a is an ancestor
of s and no ancestor's delete with a later sequence has its hash, so a triple
that was deleted and added again is seen. File access goes through Hadoop, so
any file system that Spark reads works.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.schema import NothingBuilt, TesseraError


FILE_ROWS = 4_000_000  # triples of a file, about


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, name: str) -> str | None:
        fs, p = self._fs(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        """Make a file that must not exist yet, whole."""
        fs, p = self._fs(name)
        if fs.getScheme() == "file":
            # a hard link appears whole, and fails if the name is taken
            path = p.toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            tmp = f"{path}.{time.time_ns()}.{os.getpid()}.tmp"
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(tmp, path)
            except FileExistsError as e:
                raise TesseraError(f"{name} exists: another writer was first") from e
            finally:
                os.remove(tmp)
            return
        if fs.exists(p):
            raise TesseraError(f"{name} exists: another writer was first")
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _names(self, folder: str, suffix: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(n for f in fs.listStatus(p) if (n := f.getPath().getName()).endswith(suffix)) if fs.exists(p) else []

    # log

    def log(self) -> list[dict]:
        """All commits by sequence; those of deleted snapshots are marked."""
        dropped = set(self._names("_log", ".dropped"))
        return [json.loads(self._read(f"_log/{n}")) | {"dropped": n.replace(".json", ".dropped") in dropped} for n in self._names("_log", ".json")]

    def live(self) -> list[dict]:
        return [e for e in self.log() if not e["dropped"]]

    def refs(self) -> dict[str, int]:
        names = self._names("_refs", ".json")
        return json.loads(self._read(f"_refs/{names[-1]}")) if names else {}

    def _set_refs(self, refs: dict[str, int]) -> None:
        names = self._names("_refs", ".json")
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        self._create(f"_refs/{number:012d}.json", json.dumps(refs))

    def tag(self, name: str, snapshot_id: int | None = None) -> None:
        self._set_refs(self.refs() | {name: self.current()["snapshot_id"] if snapshot_id is None else snapshot_id})

    def is_stale(self, tag: str) -> bool:
        """Whether the current snapshot does not carry a tag: the sources have moved on since the last build."""
        return self.refs().get(tag) != self.current()["snapshot_id"]

    def current(self) -> dict:
        log = self.live()
        if not log:
            raise NothingBuilt(f"nothing is built at {self.path} yet: run a build first")
        main = self.refs().get("main")
        return next((e for e in log if e["snapshot_id"] == main), log[-1])

    def ancestry(self, snapshot_id: int) -> list[dict]:
        by = {e["snapshot_id"]: e for e in self.log()}
        if snapshot_id not in by or by[snapshot_id]["dropped"]:
            raise TesseraError(f"unknown snapshot {snapshot_id}")
        out, at = [], snapshot_id
        while at is not None and at in by:
            out.append(by[at])
            at = by[at]["parent"]
        return out

    def snapshots(self) -> DataFrame:
        """(sequence_number, snapshot_id, parent_id, timestamp_ms, operation, tags), newest first."""
        tags: dict[int, list[str]] = {}
        for t, i in self.refs().items():
            tags.setdefault(i, []).append(t)
        rows = [(e["seq"], e["snapshot_id"], e["parent"], e["ts"], e["operation"], ", ".join(sorted(tags.get(e["snapshot_id"], [])))) for e in reversed(self.live())]
        return self.spark.createDataFrame(rows, "sequence_number long, snapshot_id long, parent_id long, timestamp_ms long, operation string, tags string")

    def properties(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.current()["properties"].items()), "key string, value string")

    def modules(self) -> list[str]:
        """The modules that the table's properties record; none if the record is no list."""
        try:
            found = json.loads(self.current()["properties"].get("modules", "[]"))
        except ValueError:
            return []
        return [str(m) for m in found] if isinstance(found, list) else []

    def sample_queries(self) -> list[tuple[str, str]]:
        """(name, SQL) that look at each snapshot as it was; engines register these views by ``Engine.register_snapshots``."""
        return [(f"Snapshot {e['seq']} ({e['operation']})", f"SELECT * FROM triples_at_{e['snapshot_id']} ORDER BY triple_hash LIMIT 100") for e in reversed(self.live())]

    # reading

    def _data(self, entries: list[dict]) -> DataFrame:
        schema = S.TRIPLES.simpleString()[7:-1].replace(":", " ") + f", {S.PARTITION} string"
        frames = [self.spark.read.schema(schema).option("basePath", f"{self.path}/data/snap={e['snapshot_id']}").parquet(f"{self.path}/data/snap={e['snapshot_id']}").withColumn("_seq", F.lit(e["seq"])) for e in entries if e["added"]]
        if not frames:
            return self.spark.createDataFrame([], schema + ", _seq int")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def as_of(self, snapshot_id: int | None = None) -> DataFrame:
        """The triples of a snapshot, with the partition column that pruning uses."""
        entries = list(_plain(self.ancestry(self.current()["snapshot_id"] if snapshot_id is None else snapshot_id)))
        rows = self._data(entries)
        deletes = None
        for e in entries:
            if e["deleted"]:
                one = self.spark.read.schema("triple_hash string, predicate string").parquet(f"{self.path}/deletes/snap={e['snapshot_id']}").select("triple_hash", F.lit(e["seq"]).alias("_gone"))
                deletes = one if deletes is None else deletes.unionByName(one)
        if deletes is not None:
            last = deletes.groupBy("triple_hash").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(last, "triple_hash", "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_seq"))).drop("_gone")
        return rows.select(*S.COLUMNS, S.PARTITION)

    # writing

    def existing(self) -> DataFrame:
        """(triple_hash, predicate) of the current snapshot, none if there is no snapshot; rows without a hash are left out."""
        rows = self.as_of() if self.live() else self.spark.createDataFrame([], "triple_hash string, predicate string")
        return rows.select("triple_hash", "predicate").filter(F.col("triple_hash").isNotNull())

    def write(self, triples: DataFrame, properties: dict[str, str] | None = None, tag: str | None = None) -> dict:
        """Commit the difference to a frame of triples; no change makes no snapshot, but the tag is set."""
        new = triples.select(S.COLUMNS)
        if not self.live():
            return self._commit(new, None, properties, tag)
        old = self.existing()
        added = new.join(old.select("triple_hash").distinct(), "triple_hash", "left_anti").select(S.COLUMNS)
        gone = old.join(new.select("triple_hash").distinct(), "triple_hash", "left_anti").distinct()
        return self._commit(added, gone, properties, tag)

    def append(self, triples: DataFrame, tag: str | None = None) -> dict:
        """Commit the triples that are not there yet and delete none: what is there is read once, by hash."""
        new = triples.select(S.COLUMNS)
        added = new.join(self.existing().select("triple_hash").distinct(), "triple_hash", "left_anti").select(S.COLUMNS) if self.live() else new
        return self._commit(added, None, None, tag)

    def _commit(self, added: DataFrame, gone: DataFrame | None, properties: dict[str, str] | None, tag: str | None) -> dict:
        log = self.log()
        parent = self.current() if self.live() else None
        seq = (log[-1]["seq"] if log else 0) + 1
        snapshot_id = time.time_ns() // 1000
        n_added, n_gone = added.count(), gone.count() if gone is not None else 0
        if n_added:
            # ranges of partition, predicate and hash: files of like size, sorted by predicate, as many as the rows ask for
            part = added.withColumn(S.PARTITION, F.substring("predicate", 1, S.PARTITION_CHARS))
            part.repartitionByRange(max(1, -(-n_added // FILE_ROWS)), S.PARTITION, "predicate", "triple_hash").sortWithinPartitions(S.PARTITION, "predicate").write.partitionBy(S.PARTITION).parquet(f"{self.path}/data/snap={snapshot_id}")
        if n_gone:
            gone.repartitionByRange(max(1, -(-n_gone // FILE_ROWS)), "triple_hash").sortWithinPartitions("triple_hash").write.parquet(f"{self.path}/deletes/snap={snapshot_id}")
        if parent is not None and not n_added and not n_gone:
            entry = parent
        else:
            operation = "append" if not n_gone else "overwrite" if n_added else "delete"
            entry = {"snapshot_id": snapshot_id, "parent": parent["snapshot_id"] if parent else None, "seq": seq, "ts": time.time_ns() // 1_000_000, "operation": operation, "added": n_added, "deleted": n_gone, "properties": {**(parent["properties"] if parent else {}), **(properties or {})}}
            self._create(f"_log/{seq:012d}.json", json.dumps(entry))
            self._set_refs({**self.refs(), "main": snapshot_id})
        if tag:
            self.tag(tag, entry["snapshot_id"])
        return entry

    def diff(self, snapshot: str | int = "latest") -> DataFrame:
        """What a snapshot added and removed against its parent; all of a first one is added."""
        from tessera.operators.lookups import snapshot_diff

        if snapshot == "latest":
            i = self.current()["snapshot_id"]
        elif str(snapshot).isdigit() and int(snapshot) > 0:
            i = int(snapshot)
        else:
            raise TesseraError(f"{snapshot!r} is no snapshot: use latest or a positive id")
        new = self.as_of(i)
        parent = self.ancestry(i)[0]["parent"]
        return snapshot_diff(self.as_of(parent) if parent is not None else new.limit(0), new)

    # maintenance

    def delete_snapshots(self, ids: list[int]) -> None:
        """Hide snapshots; others may build on them. The main reference goes back to the newest one left."""
        live, gone = self.live(), set(ids)
        if unknown := gone - {e["snapshot_id"] for e in live}:
            raise TesseraError(f"unknown snapshots: {sorted(unknown)}")
        left = [e for e in live if e["snapshot_id"] not in gone]
        if not left:
            raise TesseraError("all snapshots cannot be deleted")
        refs = {t: i for t, i in self.refs().items() if i not in gone}
        refs.setdefault("main", left[-1]["snapshot_id"])
        self._set_refs(refs)
        for e in live:
            if e["snapshot_id"] in gone:
                self._create(f"_log/{e['seq']:012d}.dropped", "")

    def wipe(self) -> None:
        """Remove the whole table, the log first: what is half gone is no table any more."""
        for folder in ("_refs", "_log", "deletes", "data"):
            fs, p = self._fs(folder)
            fs.delete(p, True)

    def squash(self, ids: list[int], tag: str | None = None) -> dict:
        """Make one snapshot, with the parent of the oldest, of two or more that follow each other up to the current one.

        It shares their files. The new commit is written before anything that stands is moved, so a failure changes nothing.
        """
        chain = self.ancestry(self.current()["snapshot_id"])
        want = set(ids)
        if len(want) < 2 or {e["snapshot_id"] for e in chain[: len(want)]} != want:
            raise TesseraError("squash takes two or more snapshots that end at the current one")
        mine, seq = chain[: len(want)], self.log()[-1]["seq"] + 1
        snapshot_id = time.time_ns() // 1000
        entry = {"snapshot_id": snapshot_id, "parent": mine[-1]["parent"], "seq": seq, "ts": time.time_ns() // 1_000_000, "operation": "overwrite", "added": 0, "deleted": 0, "properties": mine[0]["properties"], "stands_for": [e for e in _plain(mine)]}
        self._create(f"_log/{seq:012d}.json", json.dumps(entry))
        moved = {t: snapshot_id if i in want else i for t, i in self.refs().items()}
        self._set_refs(moved | {"main": snapshot_id} | ({tag: snapshot_id} if tag else {}))
        for e in mine:
            self._create(f"_log/{e['seq']:012d}.dropped", "")
        return entry


def _plain(entries: list[dict]) -> Iterator[dict]:
    """Commits with files of their own, newest first."""
    for e in entries:
        yield from e["stands_for"] if "stands_for" in e else (e,)


def parse_ids(texts: list[str]) -> list[int]:
    """Snapshot ids as users give them, in order and each once."""
    out: dict[int, None] = {}
    for t in texts:
        for part in t.replace(",", " ").split():
            if not part.isdigit() or int(part) <= 0:
                raise TesseraError(f"{part!r} is no snapshot id")
            out.setdefault(int(part))
    return list(out)


def find_tables(spark: SparkSession, root: str) -> list[str]:
    """The folders below a root that hold a table, sorted; what lies inside of a table is not searched."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [path]
    while todo:
        at = todo.pop()
        inner = [f for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
        if any(f.getPath().getName() == "_log" for f in inner):
            out.append(at.toString())
        else:
            todo += [f.getPath() for f in inner]
    return sorted(out)


def lineage(local: list[int], remote: list[int]) -> str:
    """How two snapshot lists stand: same, ahead, behind or diverged."""
    n = min(len(local), len(remote))
    if local[:n] != remote[:n]:
        return "diverged"
    return "same" if len(local) == len(remote) else "ahead" if len(local) > len(remote) else "behind"
