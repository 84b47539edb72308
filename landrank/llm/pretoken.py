"""Splitting of text into pre-tokens by the public byte-level pattern, with the tokenizer library's own classes.

Letter and number classes differ between Unicode versions.  Below U+0250 they are stable, and one compiled pattern
with these classes written out serves; a text with any character beyond takes its classes from the tokenizer library
itself, asked once per process which characters each class holds.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The pattern's letters, numbers and white space below U+0250.
LOW_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LOW_NUMBERS = "0-9²³¹¼½¾"
LOW_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
#: White space of any plane, as in Unicode's White_Space.
ALL_SPACES = LOW_SPACES + "  -     　"

BEYOND = re.compile("[^\\x00-ɏ]")


def _compiled(letters: str, numbers: str, spaces: str):
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
        f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


LOW = _compiled(LOW_LETTERS, LOW_NUMBERS, LOW_SPACES)


def _ranges(points: list[int]) -> str:
    out, start = [], 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            first, last = points[start], points[i - 1]
            out.append(f"\\U{first:08x}" + (f"-\\U{last:08x}" if last > first else ""))
            start = i
    return "".join(out)


@lru_cache(maxsize=1)
def _everywhere():
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def held(class_name: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=class_name, mergeable_ranks=single, special_tokens={})
        return _ranges(sorted(set(map(ord, bytes(probe.encode_ordinary(every)).decode()))))

    return _compiled(held(r"\p{L}"), held(r"\p{N}"), ALL_SPACES)


def pretokens(text: str) -> list[str]:
    return (LOW if not BEYOND.search(text) else _everywhere()).findall(text)
