"""Token ids of whole texts by the public byte-level BPE vocabulary, through installed libraries."""

from __future__ import annotations

import base64
import functools
import os
import re

import public_tokenizers

RANKS = "byte_bpe_50k.tiktoken"
JSON = "byte_bpe_50k.json"

#: Characters for which both libraries are known to split alike; a text with any other goes to tokenizers itself.
COMMON = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧]*")


@functools.lru_cache(maxsize=2)
def ranks(path: str | None = None) -> dict[bytes, int]:
    """The bytes of each token and its rank, which is its id."""
    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def by_ranks(path: str | None = None):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def by_json(path: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(JSON))


@functools.lru_cache(maxsize=2)
def added_strings(path: str | None = None) -> tuple[str, ...]:
    """Strings that tokenizers takes for one token wherever a text holds them."""
    return tuple(t.content for t in by_json(path).get_added_tokens_decoder().values())


def token_ids(texts: list[str], rank_path: str | None = None, json_path: str | None = None) -> list[list[int]]:
    """The ids that tokenizers gives, which adds no tokens at the ends but takes an added token's string in a text for that token. The rank
    file holds the same vocabulary and its library is four times as fast, so it takes the texts on which both are known to agree."""
    fast, slow, added = by_ranks(rank_path), by_json(json_path), added_strings(json_path)
    return [fast.encode_ordinary(t) if COMMON.fullmatch(t) and not any(a in t for a in added) else slow.encode(t, add_special_tokens=False).ids for t in texts]
