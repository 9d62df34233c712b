"""Access tokens of a remote service: password login, refresh, and a cache file."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

#: Seconds before its end from which a token counts as expired.
MARGIN_S = 300


def post_form(url: str, fields: dict[str, str]) -> dict | None:
    """The JSON answer to a form, or none where the service refuses it or cannot be reached."""
    try:
        with urlopen(url, urlencode(fields).encode(), timeout=30) as answer:  # noqa: S310
            return json.load(answer)
    except (HTTPError, URLError, json.JSONDecodeError):
        return None


@dataclass
class Tokens:
    """Tokens of one user.  ``password`` is asked for only when a login is needed."""

    url: str
    client_id: str
    user: str
    password: Callable[[], str]
    cache: Path
    post: Callable[[str, dict[str, str]], dict | None] = post_form
    now: Callable[[], float] = time.time

    def __call__(self) -> str:
        """A valid token: the cached one, else a refreshed one, else that of a new login."""
        held = self._load()
        if held and self.now() < held["expires_at"] - MARGIN_S:
            return held["access_token"]
        fresh = None
        if held and held.get("refresh_token"):
            fresh = self.post(self.url, {"grant_type": "refresh_token", "refresh_token": held["refresh_token"], "client_id": self.client_id})
        fresh = fresh or self.post(self.url, {"grant_type": "password", "username": self.user, "password": self.password(), "client_id": self.client_id})
        if not fresh or "access_token" not in fresh:
            raise RuntimeError(f"{self.url} gave {self.user} no token")
        self._store(fresh)
        return fresh["access_token"]

    def _load(self) -> dict | None:
        """The cached tokens; an unreadable or foreign file counts as none."""
        try:
            held = json.loads(self.cache.read_text())
        except (OSError, json.JSONDecodeError):
            return None
        return held if isinstance(held, dict) and {"access_token", "expires_at", "user"} <= held.keys() and held["user"] == self.user else None

    def _store(self, answer: dict) -> None:
        """Written beside and renamed, readable by the owner alone."""
        kept = {"user": self.user, "access_token": answer["access_token"], "refresh_token": answer.get("refresh_token"), "expires_at": self.now() + float(answer.get("expires_in", 0))}
        part = self.cache.with_suffix(".part")
        with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            json.dump(kept, f)
        part.replace(self.cache)
