"""Collections as Parquet folders under a root, with a catalog of configurations and aliases that are JSON files beside them.

All paths go through Spark's Hadoop file system, so a root may be any store that Spark can reach.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import latest


class CatalogError(ValueError):
    """A catalog change that is rejected whole."""


@dataclass(frozen=True)
class Config:
    name: str
    dim: int
    metric: str = "cosine"
    kind: str = "dense"
    full_text: bool = False

    def check(self) -> None:
        if self.dim <= 0 or self.metric not in ("cosine", "l2", "dot") or self.kind not in ("dense", "mv", "named"):
            raise CatalogError(f"bad configuration {self}")


class Catalog:
    """Names to tables.

    The catalog is a small file for each of its versions, ``catalog.<n>.json``. A change is written beside them under another name and then
    renamed to the next number, which fails if that number exists: there is no moment without a catalog, and of two writers that
    started from one version the second reads again and repeats its change.
    """

    #: Versions of the catalog that stay, and how often a change that lost to another is repeated.
    KEPT, TRIES = 8, 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.root))

    def _versions(self) -> list[int]:
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for x in names if (m := re.fullmatch(r"catalog\.(\d+)\.json", x)))

    def _read(self) -> tuple[int, dict]:
        """The newest version and what it holds."""
        if not (found := self._versions()):
            return 0, {"collections": {}, "aliases": {}}
        rows = self.spark.read.text(f"{self.root}/catalog.{found[-1]}.json", wholetext=True).collect()
        return found[-1], json.loads("".join(r[0] for r in rows))

    def _load(self) -> dict:
        return self._read()[1]

    def _write(self, number: int, state: dict) -> bool:
        """Write a version; False if another writer has it."""
        fresh, at = self._path(f"{self.root}/.catalog.{uuid.uuid4().hex}"), self._path(f"{self.root}/catalog.{number}.json")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        hadoop, gateway = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        context = hadoop.FileContext.getFileContext(self._path(self._fs.makeQualified(at).toString()).toUri(), self._conf)
        qualified = [self._path(self._fs.makeQualified(x).toString()) for x in (fresh, at)]
        try:
            context.rename(*qualified, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(fresh, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        for old in self._versions()[: -self.KEPT]:
            self._fs.delete(self._path(f"{self.root}/catalog.{old}.json"), False)
        return True

    def _change(self, change: Callable[[dict], None]) -> dict:
        """Apply ``change`` to the newest version and write the next one; ``change`` may raise, and may run again."""
        for _ in range(self.TRIES):
            number, state = self._read()
            change(state)
            if self._write(number + 1, state):
                return state
        raise CatalogError("the catalog could not be written: other writers change it all the time")

    def create(self, config: Config) -> None:
        config.check()

        def change(state: dict) -> None:
            if config.name in state["collections"] or config.name in state["aliases"]:
                raise CatalogError(f"{config.name} exists")
            state["collections"][config.name] = asdict(config) | {"version": 0}

        self._change(change)

    def drop(self, name: str) -> None:
        def change(state: dict) -> None:
            if state["collections"].pop(name, None) is None:
                raise CatalogError(f"no collection {name}")
            state["aliases"] = {a: t for a, t in state["aliases"].items() if t != name}

        self._change(change)
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def names(self) -> list[str]:
        return sorted(self._load()["collections"])

    def resolve(self, name: str) -> str:
        state = self._load()
        target = state["aliases"].get(name, name)
        if target not in state["collections"]:
            raise CatalogError(f"no collection {name}")
        return target

    def config(self, name: str) -> Config:
        found = self._load()["collections"][self.resolve(name)]
        return Config(**{k: v for k, v in found.items() if k in Config.__dataclass_fields__})

    def version(self, name: str) -> int:
        """The newest version of a collection's table, 0 before the first."""
        return self._load()["collections"][self.resolve(name)]["version"]

    def aliases(self) -> dict[str, str]:
        return self._load()["aliases"]

    def swap_aliases(self, changes: list[tuple[str, str | None]]) -> None:
        """Set (alias, target) or delete (alias, None), all or nothing."""

        def change(state: dict) -> None:
            for alias, target in changes:
                if target is None:
                    if state["aliases"].pop(alias, None) is None:
                        raise CatalogError(f"no alias {alias}")
                elif target not in state["collections"] or alias in state["collections"]:
                    raise CatalogError(f"alias {alias} cannot name {target}")
                else:
                    state["aliases"][alias] = target

        self._change(change)

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """A new version of a collection's table, which is returned; readers of the old one are undisturbed. A writer whose number
        another writer took first is refused, so no version is lost."""
        target = self.resolve(name)
        version = self._load()["collections"][target]["version"] + 1
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{target}/v{version}")

        def change(state: dict) -> None:
            if state["collections"].get(target, {}).get("version") != version - 1:
                raise CatalogError(f"{target} was written meanwhile")
            state["collections"][target]["version"] = version

        self._change(change)
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A collection's table, or a former version of it."""
        target = self.resolve(name)
        if self._load()["collections"][target].get("cold"):
            raise CatalogError(f"{target} is cold; promote it first")
        return self.spark.read.parquet(f"{self.root}/{target}/v{version or self._load()['collections'][target]['version']}")

    def snapshot(self, path: str) -> None:
        """All collections and the catalog under another path."""
        state = self._load()
        for name, config in state["collections"].items():
            if config["version"]:
                self.read(name).write.parquet(f"{path}/{name}/v{config['version']}")
        if not Catalog(self.spark, path)._write(1, state):
            raise CatalogError(f"{path} holds a catalog")

    # bulk loads

    def stage(self, name: str, df: DataFrame) -> str:
        """Append rows to a collection's staging area without touching what readers see; returns the batch's folder."""
        target = self.resolve(name)
        dim = Config(**{k: v for k, v in self._load()["collections"][target].items() if k in Config.__dataclass_fields__}).dim
        if "vector" in df.columns and not df.where(F.size("vector") != dim).isEmpty():
            raise CatalogError(f"{target} takes vectors of {dim} dimensions")
        path = f"{self.root}/{target}/staged/batch-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return path

    def build(self, name: str, key: str = "id", seq: str = "seq") -> int:
        """One new version of the collection from its present one and all staged batches, the last row of an id by ``seq``; staging is then empty."""
        target = self.resolve(name)
        root = self._path(f"{self.root}/{target}/staged")
        if not self._fs.exists(root):
            raise CatalogError(f"nothing is staged for {target}")
        paths = sorted(str(f.getPath().toString()) for f in self._fs.listStatus(root))
        rows = self.spark.read.parquet(*paths)
        if self._load()["collections"][target]["version"]:
            old = self.read(target)
            rows = old.withColumn(seq, F.lit(-1).cast("long")).unionByName(rows) if seq not in old.columns else old.unionByName(rows)
        version = self.write(target, latest(rows, key, seq))
        for path in paths:
            self._fs.delete(self._path(path), True)
        return version

    # tiers

    def evict(self, name: str, cold: str) -> None:
        """Move a collection's table to another path; it stays in the catalog and can be promoted again."""
        state, target = self._load(), self.resolve(name)
        version = state["collections"][target]["version"]
        if not version or state["collections"][target].get("cold"):
            raise CatalogError(f"{target} has no warm table")
        path = f"{cold.rstrip('/')}/{target}/v{version}"
        self.read(target).write.parquet(path)
        self._change(lambda s: s["collections"][target].update(cold=path))
        self._fs.delete(self._path(f"{self.root}/{target}/v{version}"), True)

    def promote(self, name: str) -> None:
        """Bring an evicted table back."""
        state, target = self._load(), self.resolve(name)
        if not (path := state["collections"][target].get("cold")):
            raise CatalogError(f"{target} is warm")
        version = state["collections"][target]["version"]
        self.spark.read.parquet(path).write.mode("overwrite").parquet(f"{self.root}/{target}/v{version}")
        self._change(lambda s: s["collections"][target].pop("cold"))

    def touch(self, name: str, now_ms: int) -> None:
        """Note that a collection was used."""
        target = self.resolve(name)
        self._change(lambda s: s["collections"][target].update(used_ms=now_ms))

    def sweep_idle(self, cold: str, now_ms: int, idle_ms: int) -> list[str]:
        """Evict the warm collections that nobody has used for ``idle_ms``."""
        idle = [n for n, c in self._load()["collections"].items() if c["version"] and not c.get("cold") and now_ms - c.get("used_ms", 0) >= idle_ms]
        for name in sorted(idle):
            self.evict(name, cold)
        return sorted(idle)
