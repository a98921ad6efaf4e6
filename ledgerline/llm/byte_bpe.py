"""Token ids by a byte-level BPE tokenizer file."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerline.llm.part_ids import PartIds

# Pre-tokens hold a space only in front, but for runs of white space. A text may thus be cut
# before every space, unless a run holds one between white space or at the text's end.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INSIDE_A_RUN = f"{SPACE} (?:{SPACE}|\\z)"
AFTER_A_WORD = re.compile(r"(?<=\S)(?= )")
MARK = "\x01"  # set before spaces to cut there
LONGEST = 4096  # characters of a chunk; longer ones are left to the library


def unit_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary of a byte-level file: itself
    where it is printable Latin-1, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteIds:
    """Ids of whole texts, as the file's library gives them without added special tokens;
    special strings inside a text are special tokens.

    Texts are cut into chunks, a word with the space before it and the signs behind it, and
    unknown chunks are encoded many at a time.
    """

    loaded: dict[str, ByteIds] = {}

    def __init__(self, path: str, memory: int = 96 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in content["added_tokens"]]
        bytes_of = unit_characters()
        ranks = {
            bytes(bytes_of[c] for c in token): number
            for token, number in content["model"]["vocab"].items()
            if token not in self.special
        }
        self.fast = tiktoken.Encoding(
            "chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, number in ranks.items():
            self.width[number] = len(token)
        self.chunks = PartIds(self._encode_chunks, memory)

    @classmethod
    def load(cls, path: str) -> ByteIds:
        """The one of this Python worker, which serves many tasks."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (strings without nulls)."""
        special = pc.match_substring(texts, MARK)
        for string in self.special:
            special = pc.or_(special, pc.match_substring(texts, string))
        by_hand = pc.or_(special, pc.match_substring_regex(texts, INSIDE_A_RUN))
        plain = pc.if_else(by_hand, "", texts)
        ids = self.chunks.of(pc.split_pattern(pc.replace_substring(plain, " ", f"{MARK} "), MARK))
        for row in np.flatnonzero(by_hand.to_numpy(zero_copy_only=False)).tolist():
            text = texts[row].as_py()
            if special[row].as_py():
                ids[row] = self._by_library(text)
            else:
                ids[row] = b"".join(self._encode_chunks(AFTER_A_WORD.split(text)))
        return ids

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The chunks must not hold special strings."""
        found: list[bytes] = [b""] * len(chunks)
        joined = []
        for at, chunk in enumerate(chunks):
            if chunk[:1] == " " and not chunk[-1:].isspace() and len(chunk) <= LONGEST:
                joined.append(at)  # does not run into its neighbours
            elif len(chunk) > LONGEST:
                found[at] = self._by_library(chunk)
            else:
                found[at] = np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()
        for start in range(0, len(joined), 4096):
            part = joined[start : start + 4096]
            texts = [chunks[i] for i in part]
            ids = np.array(self.fast.encode_ordinary("".join(texts)), "<u4")
            ends = np.cumsum(pc.binary_length(pa.array(texts)).to_numpy())
            ends = 4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)
            data, at = ids.tobytes(), 0
            for i, end in zip(part, ends.tolist(), strict=True):
                found[i] = data[at:end]
                at = end
        return found

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
