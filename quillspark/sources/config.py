"""Settings from the environment, and a template for the file that may hold them."""

from __future__ import annotations

import os
from collections.abc import Mapping

#: What a live model needs.
NEEDED = ("MODEL_API_KEY",)


def read_env_file(path: str) -> dict[str, str]:
    """``NAME=value`` lines of a file; comments, blank lines and quotes around values are left out."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    return out


def settings(env_file: str, names: tuple[str, ...] = NEEDED, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """The named settings: those of the environment, else those of the file. Missing ones end the run."""
    own = os.environ if environ is None else environ
    found = read_env_file(env_file) | {n: own[n] for n in names if own.get(n)}
    if missing := [n for n in names if not found.get(n)]:
        raise RuntimeError(f"set {', '.join(missing)} in the environment or in {env_file}")
    return {n: found[n] for n in names}


def write_template(env_file: str, names: tuple[str, ...] = NEEDED) -> bool:
    """Whether the file was there; if not, one to fill in is written."""
    if os.path.exists(env_file):
        return True
    with open(env_file, "w", encoding="utf-8") as f:
        f.write("# settings of the extraction model\n" + "".join(f"{n}=your_{n.lower()}_here\n" for n in names))
    return False
