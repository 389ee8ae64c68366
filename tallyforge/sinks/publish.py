"""Publication that creates once: missing outputs are written, identical ones left, any difference refuses all.

Tables are compared by content, not by file, so another partitioning of the same rows is identical.
Documents (small records on the driver) are compared by bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(Exception):
    """Something already published differs from what would be written."""


def record_json(columns: Sequence[str]) -> Column:
    """Rows as JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def with_hash(df: DataFrame, columns: Sequence[str], name: str = "sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(record_json(columns), 256))


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash that is the same for the same rows in any order: sums of row hashes, combined map-side."""
    marked = [x for c in sorted(df.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    low = F.xxhash64(F.lit(1), *marked).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.xxhash64(F.lit(2), *marked).bitwiseAND(F.lit(0xFFFFFFFF))
    n, a, b, x = df.agg(F.count(F.lit(1)), F.sum(low), F.sum(high), F.bit_xor(F.xxhash64(*marked))).first()
    schema = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    return n, hashlib.sha256(json.dumps([n, a or 0, b or 0, x or 0, schema]).encode()).hexdigest()


def publish_tables(outputs: Mapping[str, DataFrame]) -> dict[str, str]:
    """Path to ``written`` or ``unchanged``. All are compared before the first is written."""
    state, wanted = {}, {}
    for path, df in outputs.items():
        wanted[path] = table_digest(df)
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            state[path] = "missing"
        else:
            state[path] = "unchanged" if table_digest(spark.read.parquet(path)) == wanted[path] else "different"
    differing = sorted(p for p, s in state.items() if s == "different")
    if differing:
        raise Refused(", ".join(differing))
    for path, df in outputs.items():
        if state[path] == "missing":
            df.write.mode("errorifexists").parquet(path)
            if table_digest(df.sparkSession.read.parquet(path)) != wanted[path]:
                raise Refused(f"{path}: what was written is not what was asked for")
            state[path] = "written"
    return state


def document_bytes(document: object) -> bytes:
    return (json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode("utf-8")


def publish_documents(root: str, documents: Mapping[str, bytes]) -> dict[str, str]:
    """The same contract for files below a local or mounted root; each appears whole or not at all."""
    targets = {}
    for name in documents:
        path = os.path.realpath(os.path.join(root, name))
        if not path.startswith(os.path.realpath(root) + os.sep):
            raise Refused(f"{name}: outside the root")
        targets[name] = path
    state = {}
    for name, path in targets.items():
        if not os.path.lexists(path):
            state[name] = "missing"
        else:
            with open(path, "rb") as f:
                state[name] = "unchanged" if f.read() == documents[name] else "different"
    differing = sorted(n for n, s in state.items() if s == "different")
    if differing:
        raise Refused(", ".join(differing))
    for name, path in targets.items():
        if state[name] != "missing":
            continue
        os.makedirs(os.path.dirname(path), exist_ok=True)
        staged, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
        try:
            with os.fdopen(staged, "wb") as f:
                f.write(documents[name])
                f.flush()
                os.fsync(f.fileno())
            os.link(temporary, path)  # fails if it has come to exist meanwhile
        except FileExistsError as e:
            raise Refused(name) from e
        finally:
            os.unlink(temporary)
        state[name] = "written"
    return state


def copy_verified(source: str, target: str, manifest: Mapping[str, str]) -> int:
    """Copies the files of a manifest (relative path to sha256) into a new folder, or leaves nothing."""
    if os.path.lexists(target):
        raise Refused(f"{target} exists")
    parent = os.path.dirname(os.path.abspath(target))
    os.makedirs(parent, exist_ok=True)
    staging = tempfile.mkdtemp(dir=parent)
    try:
        for name, digest in manifest.items():
            path = os.path.realpath(os.path.join(source, name))
            if not path.startswith(os.path.realpath(source) + os.sep):
                raise Refused(f"{name}: outside the source")
            to = os.path.join(staging, name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            shutil.copyfile(path, to)
            actual = hashlib.sha256()
            with open(to, "rb") as f:
                while block := f.read(1 << 20):
                    actual.update(block)
            if actual.hexdigest() != digest:
                raise Refused(f"{name}: hash differs")
        # the name is claimed first: making a folder fails where anything has come to exist meanwhile, and a
        # folder replaces only an empty one, which is then our own
        try:
            os.mkdir(target)
            os.rename(staging, target)
        except OSError as e:
            raise Refused(f"{target} exists") from e
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return len(manifest)
