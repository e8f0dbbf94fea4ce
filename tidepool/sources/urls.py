"""Lists of web addresses: which of them may be fetched, and fetching them in the tasks."""

from __future__ import annotations

import ipaddress
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pixels import image_format
from .images import SUFFIXES

MOST_BYTES = 50 * 1024 * 1024
#: Addresses that are not of the public net.
_PRIVATE = r"^(127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """url, one for each line that is not blank."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")


def url_error(url: Column | str) -> Column:
    """Why an address may not be fetched; empty where it may."""
    url = F.col(url) if isinstance(url, str) else url
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    suffix = F.lower(F.regexp_extract(url, r"^[^?#]*\.([A-Za-z0-9]+)(?:[?#]|$)", 1))
    return (
        F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme must be http or https")
        .when(host == "", "no host")
        .when((host == "localhost") | host.endswith(".localhost") | host.rlike(_PRIVATE) | host.rlike(r"^\[(::1|::|fe[89ab].*|f[cd].*)\]$"), "host is not public")
        .when(~suffix.isin(*SUFFIXES), "suffix is not that of an image")
        .otherwise("")
    )


def is_public(host: str) -> bool:
    if host.lower() == "localhost":
        return False
    try:
        return ipaddress.ip_address(host.strip("[]")).is_global
    except ValueError:
        return True


def fetch(url: str, timeout: float = 30) -> bytes:
    if not is_public(urlparse(url).hostname or ""):
        raise ValueError("host is not public")
    with urllib.request.urlopen(url, timeout=timeout) as r:
        if not r.headers.get_content_type().startswith("image/"):
            raise ValueError(f"content type {r.headers.get_content_type()}")
        data = r.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError("larger than 50 MiB")
    if not image_format(data):
        raise ValueError("not an image")
    return data


def download(urls: DataFrame, get: Callable[[str], bytes] = fetch) -> DataFrame:
    """url, content and error: each address by itself, in the tasks."""
    checked = urls.select("url", url_error("url").alias("error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data, errors = [], []
            for url, error in zip(frame["url"], frame["error"], strict=True):
                try:
                    if error:
                        raise ValueError(error)
                    data.append(get(url))
                    errors.append("")
                except Exception as e:
                    data.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"url": frame["url"], "content": data, "error": errors})

    return checked.mapInPandas(run, "url string, content binary, error string")
