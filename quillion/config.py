"""Settings of the engine, read from the environment and checked."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")


@dataclass(frozen=True)
class Settings:
    """Limits and identities for the sources. Blank values count as unset."""

    pubmed_limit: int = 20
    crossref_limit: int = 20
    provider_timeout: float = 18.0
    retry_backoff: float = 1.0
    pubmed_api_key: str | None = None
    contact_email: str | None = None

    def __post_init__(self) -> None:
        for name in ("pubmed_limit", "crossref_limit"):
            if not 1 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be between 1 and 100")
        if not 0 < self.provider_timeout <= 60:
            raise ValueError("provider_timeout must be over 0 and at most 60 seconds")
        for name in ("pubmed_api_key", "contact_email"):
            if not (getattr(self, name) or "").strip():
                object.__setattr__(self, name, None)
        if self.contact_email is not None and not _EMAIL.fullmatch(self.contact_email.strip()):
            raise ValueError("contact_email is not an email address")

    @property
    def rates(self) -> dict[str, int]:
        """Requests a second that each source allows: more with a key or a contact."""
        return {"pubmed": 10 if self.pubmed_api_key else 3, "crossref": 3 if self.contact_email else 1}

    @classmethod
    def from_env(cls, prefix: str = "QUILLION_", env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {f.name: env[k] for f in fields(cls) if (k := prefix + f.name.upper()) in env and env[k].strip()}
        kinds = {"pubmed_limit": int, "crossref_limit": int, "provider_timeout": float, "retry_backoff": float}
        return cls(**{k: kinds.get(k, str)(v) for k, v in given.items()})
