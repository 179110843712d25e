"""Files of public tokenizers: read from where they are installed, never copied here."""

from __future__ import annotations

import base64


def public_path(name: str) -> str:
    """The place of an installed vocabulary file on this machine; executors ask for their own."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def rank_pieces(name: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(public_path(name), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]
