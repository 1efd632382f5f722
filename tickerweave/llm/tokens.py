"""The byte-level vocabulary: one merge-rank file, read once on the driver and sent to the tasks."""

from __future__ import annotations

import base64

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def read_ranks(path: str = BYTE_BPE) -> dict[bytes, int]:
    """Piece to rank. The file is a vocabulary of fixed size, a few MB at most."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
