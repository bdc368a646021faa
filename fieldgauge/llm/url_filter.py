"""URL filters in sorted digest arrays: memory-mapped 64-bit keys, binary search, confirmation by full string.

A rule is a host, a path prefix and a verdict; it fits its host and all subdomains where the url's path starts with the
prefix, and the longest rule wins. `build` writes a list of any length as shards: a shard has the sorted xxhash64 keys of
its rules (host + path) as a raw array, the offsets and bytes of the full strings, and the verdicts. Rules are dealt to
shards by the top bits of their keys, evenly whatever the hosts are. `judge` maps the arrays into memory once per worker
and probes a batch's candidate keys (each suffix of the host with each path prefix length in use) by one vectorised
binary search per shard; a hit counts only if the stored string is the candidate, so colliding keys cannot mislead.

Edge cases: a null url, or one without `://`, has an empty host and path and fits no rule. Hosts are lower-cased A-Z
only. Of equal rules the last in (verdict) order, block over allow, wins. An empty list gives every url the default verdict. Rows
are judged one by one; ids may be null or repeated; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lower_ascii
from .files import place, put
from .tables import workspace

SHARD_RULES = 1_000_000
VERDICTS = ("allow", "block")
DEFAULT = "allow"
RULE_SCHEMA = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


@dataclass(frozen=True)
class FilterList:
    """Where the shards lie, how many bits choose one, and the path lengths in use."""

    folder: str
    bits: int
    path_lengths: tuple[int, ...]


def build(rules: DataFrame, shard_rules: int = SHARD_RULES) -> FilterList:
    """Write the rules' sorted arrays to the shared folder, a task per shard."""
    folder = f"{workspace(rules, 'url-filter')}/{uuid.uuid4().hex}"
    clean = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in clean.select(F.length("path")).distinct().collect())
    bits = max(0, (max(1, clean.count()) - 1) // shard_rules).bit_length()

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = np.array([_key(f"{h}{p}".encode()) for h, p in zip(frame["host"], frame["path"])], np.uint64)
            shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            yield frame.assign(key=keys.view(np.int64), shard=shard)

    def store(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(key=group["key"].to_numpy().view(np.uint64)).sort_values(["key", "host", "path"])
        strings = [json.dumps([h, p]).encode() for h, p in zip(group["host"], group["path"])]
        offsets = np.cumsum([0, *map(len, strings)], dtype=np.uint64)
        verdicts = np.array([VERDICTS.index(v) for v in group["verdict"]], np.uint8)
        shard = int(group["shard"].iloc[0])
        parts = {"keys": group["key"].to_numpy().tobytes(), "offsets": offsets.tobytes(), "strings": b"".join(strings), "verdicts": verdicts.tobytes()}
        for name, content in parts.items():
            put(f"{folder}/{shard}", name, content)
        return pd.DataFrame({"shard": [shard], "n": [len(group)]})

    clean.mapInPandas(keyed, f"{RULE_SCHEMA}, key long, shard long").groupBy("shard").applyInPandas(store, "shard long, n long").collect()
    return FilterList(folder, bits, tuple(lengths))


class _Shard:
    opened: dict[tuple[str, int], "_Shard | None"] = {}

    def __init__(self, folder: str, shard: int):
        self.keys, self.offsets = self._mapped(folder, shard, "keys", np.uint64), self._mapped(folder, shard, "offsets", np.uint64)
        self.strings, self.verdicts = self._mapped(folder, shard, "strings", np.uint8), self._mapped(folder, shard, "verdicts", np.uint8)

    @staticmethod
    def _mapped(folder: str, shard: int, name: str, kind) -> np.ndarray:
        where, path = place(folder)
        path = f"{path}/{shard}/{name}"
        if not isinstance(where, fs.LocalFileSystem):
            # A store that cannot be mapped is copied once to the worker's own disk.
            own = os.path.join(tempfile.mkdtemp(), name)
            with where.open_input_stream(path, compression=None) as source, open(own, "wb") as target:
                while block := source.read(1 << 24):
                    target.write(block)
            path = own
        return np.memmap(path, kind, "r")

    @classmethod
    def get(cls, folder: str, shard: int) -> "_Shard | None":
        if (folder, shard) not in cls.opened:
            where, path = place(folder)
            there = where.get_file_info(f"{path}/{shard}/keys").type != fs.FileType.NotFound
            cls.opened[(folder, shard)] = cls(folder, shard) if there else None
        return cls.opened[(folder, shard)]

    def find(self, keys: np.ndarray, wanted: list[tuple[str, str]]) -> np.ndarray:
        """Row of each candidate, -1 where there is none; equal keys of different strings are all looked at."""
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(keys), -1, np.int64)
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)):
            row = at[k]
            while row < len(self.keys) and self.keys[row] == keys[k]:
                text = bytes(self.strings[int(self.offsets[row]) : int(self.offsets[row + 1])])
                if tuple(json.loads(text)) == wanted[k]:
                    out[k] = row
                    break
                row += 1
        return out


def _suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[k:]) for k in range(len(parts))] if host else []


def judge(pages: DataFrame, filters: FilterList, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(<page_id>, host, path, rule, verdict): the longest rule that fits, else null and the default verdict."""
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys, wanted, of = [], [], []
            for k, (h, p) in enumerate(zip(hosts, paths)):
                for suffix in _suffixes(h):
                    for n in filters.path_lengths:
                        if n <= len(p):
                            keys.append(_key(f"{suffix}{p[:n]}".encode()))
                            wanted.append((suffix, p[:n]))
                            of.append(k)
            keys, of = np.array(keys, np.uint64), np.array(of, np.int64)
            shard = (keys >> np.uint64(64 - filters.bits)).astype(np.int64) if filters.bits else np.zeros(len(keys), np.int64)
            best: dict[int, tuple] = {}
            for s in np.unique(shard):
                table, here = _Shard.get(filters.folder, int(s)), np.flatnonzero(shard == s)
                if table is None:
                    continue
                found = table.find(keys[here], [wanted[k] for k in here])
                for k, row in zip(here[found >= 0], found[found >= 0]):
                    h, p = wanted[k]
                    rank = (len(h) + len(p), len(h), f"{h}{p}", VERDICTS[table.verdicts[row]])
                    best[of[k]] = max(best.get(of[k], rank), rank)
            rules = [best[k][2] if k in best else None for k in range(len(hosts))]
            verdicts = [best[k][3] if k in best else default for k in range(len(hosts))]
            columns = [*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "host", "path", "rule", "verdict"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", page_id)
