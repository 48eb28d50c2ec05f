"""Token ids of public vocabularies, loaded once per Python worker."""

from __future__ import annotations

import functools
import json

import numpy as np


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte, to that byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelIds:
    """Ids of a byte-level vocabulary in the ``tokenizers`` format, without added special tokens.

    The merges run in ``tiktoken``, which is several times faster on words seen once; that gives
    the same ids because every id of the vocabulary is the rank of its merge, which is checked
    when the file is read. A text that ``tiktoken`` refuses goes to ``tokenizers``. A special
    token written out in a text is that token, as the library has it by default.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = byte_letters(), {t["content"]: t["id"] for t in model.get("added_tokens", ())}
        vocab = {w: i for w, i in model["model"]["vocab"].items() if w not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        if [vocab["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError(f"{path}: ids are not the ranks of the merges")
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
        self._path, self._slow, self._plain, self._ranks = path, None, None, ranks
        self._fast = tiktoken.Encoding(
            "vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.array(self._fast.encode(text, allowed_special="all"), dtype="<u4")
        except BaseException as refused:  # a panic of the extension is no Exception
            if isinstance(refused, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode_ordinary(self, text: str) -> list[int]:
        """Ids of ``text``, in which special tokens written out are text like any other."""
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as refused:  # a panic of the extension is no Exception
            if isinstance(refused, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self._path)
            self._plain.encode_special_tokens = True
        return self._plain.encode(text, add_special_tokens=False).ids

    def bytes_of(self) -> list[bytes]:
        """The bytes that each id stands for; ids that are no merges or bytes stand for none."""
        out = [b""] * (max(self._ranks.values()) + 1)
        for raw, i in self._ranks.items():
            out[i] = raw
        return out


@functools.lru_cache(maxsize=2)
def byte_level_ids(path: str) -> ByteLevelIds:
    return ByteLevelIds(path)
