"""Settings of a build, read from variables; a value that can't be read is an error that names its variable."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import NamedTuple


class NeverMark(NamedTuple):
    """A mark that the owner doesn't type, and what they type in its place, if anything."""

    mark: str
    stand_in: str | None = None


@dataclass(frozen=True)
class Config:
    owner_id: str | None = None
    burst_window_seconds: int = 90
    longform_min_chars: int = 300
    max_parts: int = 10
    context_max_age_seconds: int = 6 * 3600
    context_max_chars: int = 400
    holdout_size: int = 200
    recent_years: int = 2
    recency_weight: float = 0.12
    chat_stop_list: tuple[str, ...] = ()
    code_emails: tuple[str, ...] = ()
    handwritten_until: int = 0
    never_marks: tuple[NeverMark, ...] = field(default=())

    def recent_from(self, now_year: int) -> int:
        return now_year - self.recent_years + 1


def _whole(name: str, text: str) -> int:
    if not text.strip().isdecimal():
        raise ValueError(f"{name}: a whole number is needed, not {text!r}")
    return int(text)


def _listed(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def never_marks(text: str) -> tuple[NeverMark, ...]:
    """`mark:stand-in` pairs between commas. The mark itself may be a colon, so the first colon that
    divides stands at place 1 or later."""
    out = []
    for item in _listed(text):
        at = item.find(":", 1)
        out.append(NeverMark(item) if at < 0 else NeverMark(item[:at].strip(), item[at + 1 :].strip() or None))
    return tuple(out)


def load(env: Mapping[str, str], prefix: str = "QUILLMARK_") -> Config:
    """Config from variables such as QUILLMARK_OWNER_ID; those that are unset or blank keep their defaults."""
    got: dict[str, object] = {}
    for name, default in Config().__dict__.items():
        text = env.get(var := prefix + name.upper(), "")
        if not text.strip():
            continue
        if name == "never_marks":
            got[name] = never_marks(text)
        elif isinstance(default, tuple):
            got[name] = _listed(text)
        elif isinstance(default, float):
            try:
                got[name] = float(text)
            except ValueError:
                raise ValueError(f"{var}: a number is needed, not {text!r}") from None
        elif isinstance(default, int):
            got[name] = _whole(var, text)
        else:
            got[name] = text.strip()
    return Config(**got)
