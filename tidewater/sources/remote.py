"""Paths, handles and URLs brought to something that Spark reads."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import urllib.error
import urllib.request
import uuid
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from tidewater.errors import RemoteReadError

MAX_BYTES = 500 << 20
TIMEOUT = 30


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        raise RemoteReadError(f"{req.full_url} redirects to {newurl}; give the final address")


def scratch() -> str:
    """A folder of the driver's for downloads and handles, gone when Python ends; ``uri`` gives executors a copy."""
    folder = getattr(scratch, "folder", None)
    if folder is None:
        folder = scratch.folder = tempfile.mkdtemp(prefix="tidewater-source-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fetch(url: str, max_bytes: int = MAX_BYTES, timeout: float = TIMEOUT) -> str:
    """Downloads a URL to a local file; redirects and more than ``max_bytes`` are refused."""
    handle, path = tempfile.mkstemp(dir=scratch(), suffix="".join(Path(urlsplit(url).path).suffixes[-2:]))
    total = 0
    try:
        with os.fdopen(handle, "wb") as out, urllib.request.build_opener(_Stay).open(url, timeout=timeout) as got:
            while part := got.read(1 << 20):
                total += len(part)
                if total > max_bytes:
                    raise RemoteReadError(f"{url} is larger than {max_bytes} bytes")
                out.write(part)
    except RemoteReadError:
        raise
    except (urllib.error.URLError, OSError, ValueError) as error:
        raise RemoteReadError(f"{url}: {error}") from error
    return path


def located(source) -> str:
    """A path for Spark: local paths and Hadoop URIs as they are, http(s) downloaded, text handles copied."""
    if hasattr(source, "read"):
        body = source.read()
        handle, path = tempfile.mkstemp(dir=scratch(), suffix=".txt")
        with os.fdopen(handle, "wb") as f:
            f.write(body.encode() if isinstance(body, str) else body)
        return path
    if not isinstance(source, str | os.PathLike):
        raise TypeError(f"a source is a path, a URL or a handle, not {type(source).__name__}")
    path = os.fspath(source)
    if path.lower().startswith(("http://", "https://")):
        return fetch(path)
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def local(path: str) -> str | None:
    """The path in the driver's file system, or None for another."""
    path = path.removeprefix("file://") if path.startswith("file://") else path
    return path if "://" not in path and os.path.isfile(path) else None


def shared_root() -> str | None:
    """The folder that a cluster's executors share, or None where the session names none."""
    spark = SparkSession.getActiveSession()
    return spark.conf.get("spark.checkpoint.dir", None) if spark else None


_published: dict[str, str] = {}


def uri(path: str) -> str:
    """A path as executors see it. What lies in the driver's scratch folder is copied to the shared one first, if there is one."""
    if "://" in path:
        return path
    full = os.path.abspath(path)
    own, root = getattr(scratch, "folder", None), shared_root()
    if not (own and root and full.startswith(own + os.sep)):
        return "file://" + full
    if full not in _published:
        spark = SparkSession.getActiveSession()
        target = f"{root.rstrip('/')}/tidewater-scratch-{uuid.uuid4().hex}{''.join(Path(full).suffixes[-2:])}"
        to = spark._jvm.org.apache.hadoop.fs.Path(target)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path("file://" + full), to)
        _published[full] = target
    return _published[full]
