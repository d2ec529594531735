"""Semantic versions and versioned slugs: on the driver and as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidSlug, InvalidVersion

_VERSION = r"([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?"
_EXACT = r"^(?:([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?)?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
PARTS = ("major", "minor", "patch", "prerelease", "build")


@dataclass(frozen=True)
class Version:
    major: int = 0
    minor: int = 0
    patch: int = 0
    prerelease: str = ""
    build: str = ""

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}" + f"-{self.prerelease}" * bool(self.prerelease) + f"+{self.build}" * bool(self.build)


def parse_version(text: str) -> Version:
    found = re.match(_EXACT, text or "")
    if not text or not found:
        raise InvalidVersion(f"not a version: {text!r}")
    major, minor, patch, pre, build = found.groups()
    return Version(int(major or 0), int(minor or 0), int(patch or 0), pre or "", build or "")


def parse_slug(text: str) -> tuple[str, Version | None]:
    """(slug, version) of slug@version; no version for @latest."""
    base, at, version = text.partition("@")
    if not at or not re.fullmatch(r"[A-Za-z0-9-]+", base):
        raise InvalidSlug(f"not a versioned slug: {text!r}")
    return base, None if version == "latest" else parse_version(version)


def part(version: Column, name: str) -> Column:
    """A part of a version text: numbers as integers, the others empty where missing."""
    n = PARTS.index(name)
    text = F.regexp_extract(version, f"^{_VERSION}$", n + 1)
    return F.when(text == "", 0).otherwise(text.cast("int")) if n < 3 else text


def version_order(version: Column, descending: bool) -> list[Column]:
    """Releases come before pre-releases either way; then major, minor, patch and build in the asked direction."""
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    return [part(version, "prerelease").asc_nulls_last(), *(turn(part(version, p)) for p in ("major", "minor", "patch", "build"))]
