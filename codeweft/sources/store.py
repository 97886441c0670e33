"""Stored graphs: versions that are published at once, the embedding cache, registry, config, metadata and locks.

All lies below one folder that driver and executors share, reached through Hadoop's file systems."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import exprs as E
from codeweft.operators import search as S

VECTOR = "hash string, embedding array<float>"
#: Seconds between a holder's signs of life, and without one until a lock counts as left behind.
BEAT, STALE = 10.0, 60.0


def _given(values: dict) -> dict:
    return {k: v for k, v in values.items() if v is not None}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._owner, self._held, self._beat = uuid.uuid4().hex, set(), None

    # Small files ---------------------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self._fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf), path

    def _exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def _write(self, name: str, value: str) -> None:
        """Readers see the old or the new text: a new file takes the name in one step."""
        fs, path = self._path(name)
        new = self._fs.Path(f"{self.root}/{name}.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(value.encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(fs.getUri(), self._conf)
        option = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        option[0] = self._fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(path), option)

    def _read(self, name: str) -> str | None:
        if not self._exists(name):
            return None
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def state(self, kind: str) -> dict:
        """kind: registry (graph to path), config, or meta (graph to build)."""
        return json.loads(self._read(f"{kind}.json") or "{}")

    def _save(self, kind: str, value: dict) -> None:
        self._write(f"{kind}.json", json.dumps(value, indent=1, sort_keys=True))

    def _change(self, kind: str, f) -> dict:
        """Replaces a state by f of it. One writer at a time, so that none undoes what another wrote."""
        if not self.lock(f"state-{kind}", wait=60):
            raise TimeoutError(f"{kind} stays locked")
        try:
            out = f(self.state(kind))
            self._save(kind, out)
            return out
        finally:
            self.unlock(f"state-{kind}")

    def register(self, name: str, root: str) -> None:
        def add(known: dict) -> dict:
            if known.get(name, root) != root:
                raise ValueError(f"graph {name!r} is registered for {known[name]!r}")
            return known | {name: root}

        self._change("registry", add)

    def update_config(self, **values) -> dict:
        """Merges; None leaves a value as it is."""
        return self._change("config", lambda known: known | _given(values))

    def save_meta(self, name: str, **values) -> None:
        """Merges into the graph's entry; None leaves a value as it is."""
        self._change("meta", lambda known: known | {name: known.get(name, {}) | _given(values)})

    # Graphs --------------------------------------------------------------------------------------------------

    def publish(self, name: str, nodes: DataFrame, edges: DataFrame) -> tuple[int, int]:
        """Writes a version beside the current one, then points the name to it. Number of nodes and edges.

        The version before stays for its readers; older ones go."""
        version = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/graphs/{name}/{version}"
        nodes.write.parquet(f"{at}/nodes")
        edges.write.parquet(f"{at}/edges")
        if "text" in nodes.columns:
            words = S.postings(self.spark.read.parquet(f"{at}/nodes").select("id", "text")).withColumn("bucket", S.bucket_of(F.col("term")))
            words.repartition("bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{at}/postings")
        was = self._read(f"graphs/{name}/current")
        counts = tuple(self.spark.read.parquet(f"{at}/{t}").count() for t in ("nodes", "edges"))
        self._write(f"graphs/{name}/current", version)
        fs, folder = self._path(f"graphs/{name}")
        for status in fs.listStatus(folder):
            if status.isDirectory() and status.getPath().getName() not in (version, was):
                fs.delete(status.getPath(), True)
        return counts

    def graph(self, name: str) -> tuple[DataFrame, DataFrame]:
        version = self._read(f"graphs/{name}/current")
        if version is None:
            raise KeyError(f"no graph {name!r}")
        return tuple(self.spark.read.parquet(f"{self.root}/graphs/{name}/{version}/{t}") for t in ("nodes", "edges"))

    def postings(self, name: str) -> DataFrame | None:
        """term, id, tf and bucket (the folder) of the graph's texts, for search.lexical(); None for a graph without."""
        version = self._read(f"graphs/{name}/current")
        at = f"graphs/{name}/{version}/postings"
        if version is None or not self._exists(at):
            return None
        return self.spark.read.schema("term string, id string, tf long, bucket int").parquet(f"{self.root}/{at}")

    def graphs(self) -> DataFrame:
        """graph, path (null if not registered), by name."""
        fs, folder = self._path("graphs")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        known = self.state("registry")
        return self.spark.createDataFrame([(n, known.get(n)) for n in sorted(names) if self._exists(f"graphs/{n}/current")], "graph string, path string")

    # Embedding cache -----------------------------------------------------------------------------------------

    def _cache(self, model: str) -> str:
        folder = self.spark.range(1).select(E.sanitize(F.lit(model))).first()[0]
        return f"emb_cache/model={folder}"

    def cached(self, model: str) -> DataFrame:
        """hash, embedding. A repeated hash, left by concurrent writers, counts once."""
        at = self._cache(model)
        if not self._exists(at):
            return self.spark.createDataFrame([], VECTOR)
        return self.spark.read.schema(VECTOR).parquet(f"{self.root}/{at}").dropDuplicates(["hash"])

    def missing(self, model: str, texts: DataFrame) -> DataFrame:
        """The distinct hash and text of texts that the cache lacks."""
        return texts.select("hash", "text").dropDuplicates(["hash"]).join(self.cached(model).select("hash"), "hash", "left_anti")

    def add_vectors(self, model: str, vectors: DataFrame, parts: int = 1) -> None:
        """Appends hash and embedding in so many commits, by hash: after a break the next load goes on from the last."""
        for i in range(parts):
            vectors.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == i).write.mode("append").parquet(f"{self.root}/{self._cache(model)}")

    # Locks ---------------------------------------------------------------------------------------------------

    def lock(self, name: str, wait: float = 0.0, stale: float = STALE) -> bool:
        """Takes a lock, waiting so many seconds: a file that only one can create, with its owner in it. The holder gives
        signs of life by the file's time; without one for `stale` seconds the lock counts as left behind by a process
        that has died, and is taken over."""
        fs, path = self._path(f"locks/{name}")
        until, misses = time.time() + wait, 0
        while True:
            try:
                out = fs.create(path, False)
                out.write(bytearray(self._owner.encode()))
                out.close()
                self._held.add(name)
                self._keep_alive()
                return True
            except Exception:  # noqa: BLE001 - py4j wraps FileAlreadyExistsException
                misses += not fs.exists(path)  # released just now, or it can't be made at all
                if misses > 20:
                    raise
            self._take_away(name, stale)
            if time.time() >= until and fs.exists(path):
                return False
            time.sleep(0.05)

    def _age(self, name: str) -> float:
        """Seconds since the holder's last sign, by the file system's own clock."""
        fs, path = self._path(f"locks/{name}")
        _, probe = self._path(f"locks/.now-{uuid.uuid4().hex}")
        try:
            fs.create(probe, False).close()
            return (fs.getFileStatus(probe).getModificationTime() - fs.getFileStatus(path).getModificationTime()) / 1000
        except Exception:  # noqa: BLE001 - it went meanwhile
            return 0.0
        finally:
            fs.delete(probe, False)

    def _take_away(self, name: str, stale: float) -> None:
        """Removes a lock left behind: by a rename, which one of several succeeds with. A lock that proves to be
        another one, taken meanwhile, goes back."""
        if self._age(name) <= stale:
            return
        fs, path = self._path(f"locks/{name}")
        was, aside = self._read(f"locks/{name}"), self._path(f"locks/{name}.{uuid.uuid4().hex}")[1]
        try:
            if not fs.rename(path, aside):
                return
        except Exception:  # noqa: BLE001 - it went meanwhile
            return
        if self._read(f"locks/{aside.getName()}") != was:
            fs.rename(aside, path)
        else:
            fs.delete(aside, False)

    def _keep_alive(self) -> None:
        if self._beat is not None and self._beat.is_alive():
            return

        def beat():
            while self._held:
                for name in list(self._held):
                    fs, path = self._path(f"locks/{name}")
                    try:
                        fs.setTimes(path, int(time.time() * 1000), -1)
                    except Exception:  # noqa: BLE001 - released meanwhile, or the session ends
                        self._held.discard(name)
                time.sleep(BEAT)

        self._beat = threading.Thread(target=beat, daemon=True)
        self._beat.start()

    def unlock(self, name: str) -> None:
        """Gives up a lock, unless it was taken over meanwhile."""
        self._held.discard(name)
        if self._exists(f"locks/{name}") and self._read(f"locks/{name}") == self._owner:
            fs, path = self._path(f"locks/{name}")
            fs.delete(path, False)

    def request_rerun(self, name: str) -> None:
        """At most one load waits behind the running one."""
        self._write(f"locks/{name}.rerun", "1")

    def pending(self, name: str) -> bool:
        return self._exists(f"locks/{name}.rerun")

    def take_rerun(self, name: str) -> bool:
        fs, path = self._path(f"locks/{name}.rerun")
        return fs.delete(path, False)
