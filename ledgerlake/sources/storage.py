"""Conditional writes of one object: replace if unchanged, append if of the length that was read. The driver's part: files of its own machine, or of
any file system that Spark reads; stores with such operations of their own can stand in for these."""

from __future__ import annotations

import fcntl
import hashlib
import os
import tempfile
import time
from contextlib import contextmanager
from typing import Protocol


_own_dirs: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark is one process, as in tests."""
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir"):
        return base.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


class Store(Protocol):
    def read(self, path: str) -> tuple[bytes, str] | None:
        """The bytes and the token of their state; None if there is no object."""

    def replace(self, path: str, data: bytes, token: str | None) -> bool:
        """Whether the object, still as the token says (None: absent), is now data."""

    def append(self, path: str, data: bytes, length: int) -> bool:
        """Whether the object, still of that length, now ends with data."""

    def length(self, path: str) -> int: ...


class LocalStore:
    """Files, guarded by a lock file beside each."""

    @contextmanager
    def _locked(self, path: str):
        with open(f"{path}.lock", "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def read(self, path: str) -> tuple[bytes, str] | None:
        try:
            with open(path, "rb") as f:
                data = f.read()
        except FileNotFoundError:
            return None
        return data, hashlib.sha256(data).hexdigest()

    def replace(self, path: str, data: bytes, token: str | None) -> bool:
        with self._locked(path):
            have = self.read(path)
            if (have[1] if have else None) != token:
                return False
            with open(f"{path}.new", "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(f"{path}.new", path)
            return True

    def append(self, path: str, data: bytes, length: int) -> bool:
        with self._locked(path):
            if self.length(path) != length:
                return False
            with open(path, "ab") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            return True

    def length(self, path: str) -> int:
        return os.path.getsize(path) if os.path.exists(path) else -1


class HadoopStore:
    """Files on any of Hadoop's file systems, by the driver's JVM. A lock file beside each guards the check and the write, as its creation
    is atomic; a lock that is older than `stale` seconds was left by a writer that is gone. New bytes replace old ones by a rename."""

    def __init__(self, spark, wait: float = 30.0, stale: float = 120.0):
        self.jvm, self.wait, self.stale = spark._jvm, wait, stale
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    @contextmanager
    def _locked(self, path: str):
        fs, lock = self._at(f"{path}.lock")
        until = time.time() + self.wait
        while not fs.createNewFile(lock):
            if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > self.stale:
                fs.delete(lock, False)
            elif time.time() > until:
                raise TimeoutError(f"{path} is locked")
            time.sleep(0.02)
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _put(self, path: str, data: bytes) -> None:
        fs, new = self._at(f"{path}.new")
        out = fs.create(new, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(kinds.OVERWRITE.getClass(), 1)
        how[0] = kinds.OVERWRITE
        p = fs.makeQualified(self._at(path)[1])
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(fs.makeQualified(new), p, how)

    def read(self, path: str) -> tuple[bytes, str] | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        f = fs.open(p)
        try:
            data = bytes(f.readAllBytes())
        finally:
            f.close()
        return data, hashlib.sha256(data).hexdigest()

    def replace(self, path: str, data: bytes, token: str | None) -> bool:
        with self._locked(path):
            have = self.read(path)
            if (have[1] if have else None) != token:
                return False
            self._put(path, data)
            return True

    def append(self, path: str, data: bytes, length: int) -> bool:
        with self._locked(path):
            have = self.read(path)
            if have is None or len(have[0]) != length:
                return False
            self._put(path, have[0] + data)
            return True

    def length(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen() if fs.exists(p) else -1
