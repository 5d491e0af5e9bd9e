"""Fetching releases: a catalogue over HTTPS, archives that are safe to unpack, and a cache."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import stat
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

from residuum.sources.manifests import write_text

#: Bytes that an archive may hold unpacked.
SIZE_CEILING = 1 << 30
TIMEOUT = 60
MAX_REDIRECTS = 5

Transport = Callable[[str], bytes]


class FetchError(Exception):
    """Why a release could not be had."""


class _HttpsOnly(urllib.request.HTTPRedirectHandler):
    max_redirections = MAX_REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not newurl.startswith("https://"):
            raise FetchError(f"redirect to {newurl}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def https_get(url: str) -> bytes:
    """The body at an https URL; anything but a 200 is an error."""
    if not url.startswith("https://"):
        raise FetchError(f"not https: {url}")
    try:
        with urllib.request.build_opener(_HttpsOnly()).open(url, timeout=TIMEOUT) as answer:
            if answer.status != 200:
                raise FetchError(f"status {answer.status} for {url}")
            return answer.read()
    except OSError as e:
        raise FetchError(str(e)) from e


def check_slug(slug: str) -> str:
    """A slug that can stand in a path and a URL."""
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", slug):
        raise FetchError(f"bad slug: {slug!r}")
    return slug


def latest_version(info_url: str, slug: str, get: Transport = https_get) -> str:
    """The ``version`` field of a catalogue entry."""
    try:
        found = json.loads(get(info_url.format(slug=check_slug(slug))))
    except ValueError as e:
        raise FetchError(f"no JSON for {slug}") from e
    version = found.get("version") if isinstance(found, dict) else None
    if not isinstance(version, str) or not version:
        raise FetchError(f"no version for {slug}")
    return version


def unpack(archive: bytes, target: Path) -> None:
    """Unpack a ZIP: no absolute paths, no ``..``, no drives, no links, no more than SIZE_CEILING."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            if sum(i.file_size for i in z.infolist()) > SIZE_CEILING:
                raise FetchError("archive too large")
            left = SIZE_CEILING
            for i in z.infolist():
                name = i.filename.replace("\\", "/")
                if name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"):
                    raise FetchError(f"unsafe path: {i.filename}")
                if stat.S_ISLNK(i.external_attr >> 16):
                    raise FetchError(f"link in archive: {i.filename}")
                place = target / name
                if name.endswith("/"):
                    place.mkdir(parents=True, exist_ok=True)
                    continue
                place.parent.mkdir(parents=True, exist_ok=True)
                with z.open(i) as src, place.open("wb") as out:
                    while block := src.read(1 << 20):
                        left -= len(block)
                        if left < 0:
                            raise FetchError("archive too large")
                        out.write(block)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
        raise FetchError(f"bad archive: {e}") from e


def header_version(folder: Path) -> str | None:
    """The version in the header of the first top-level file that names the plugin."""
    start = r"(?mi)^(?:[ \t]*<\?php)?[ \t/*#@]*"
    for path in sorted(p for p in folder.iterdir() if p.is_file() and p.suffix.lower() == ".php"):
        head = path.read_bytes()[:8192].decode("utf-8", "replace").replace("\r", "\n")
        if re.search(start + "Plugin Name:", head) and (m := re.search(start + "Version:(.*)$", head)):
            return re.sub(r"\s*(?:\*/|\?>).*", "", m[1]).strip() or None
    return None


def fetch(urls: dict[str, str], slug: str, version: str | None, cache: Path, get: Transport = https_get) -> Path:
    """The folder of an unpacked release; ``urls`` has info, versioned and unversioned templates.

    A cached copy counts if its checksum file is there. The unversioned archive
    stands in for a versioned one that is missing only if the version asked for is
    the latest and the header in it agrees.
    """
    latest = None
    if version is None:
        version = latest = latest_version(urls["info"], slug, get)
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._+-]*", version):
        raise FetchError(f"bad version: {version!r}")
    target = cache / f"{check_slug(slug)}-{version}"
    mark = cache / f"{slug}-{version}.sha256"
    if mark.is_file() and target.is_dir():
        return target / slug if (target / slug).is_dir() else target
    unversioned = False
    try:
        body = get(urls["versioned"].format(slug=slug, version=version))
    except FetchError:
        if version != (latest or latest_version(urls["info"], slug, get)):
            raise
        body, unversioned = get(urls["unversioned"].format(slug=slug)), True
    unpack(body, target)
    inner = target / slug if (target / slug).is_dir() else target
    if unversioned and header_version(inner) != version:
        raise FetchError(f"{slug}: the archive isn't version {version}")
    write_text(os.fspath(mark), hashlib.sha256(body).hexdigest() + "\n")
    return inner
