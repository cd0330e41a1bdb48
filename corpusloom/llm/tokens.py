"""Token ids of whole texts by the tokenizers library, made from cached words."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from corpusloom.llm.common import hold

# words are cached up to this many per generation and worker, and only short ones
CACHED_WORDS = 400_000
CACHED_BYTES = 64
# texts are split into words about this many bytes at a time, and new words encoded so many in a call
TEXT_BYTES = 2 << 20
CALL_WORDS = 20_000


class Generations(dict):
    """A cache of two generations: entries unused during one generation are dropped."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHED_BYTES:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


# byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from U+0100 on
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: b for b in _PRINTED} | {
    b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTED))
}

# characters that NFC leaves alone and whose small letters depend on nothing around them; lines with any other
_PLAIN = "\x21-\x7e\xa1-\u012f\u0131-\u017f"
_ODD = re.compile(f"^.*[^{_PLAIN}\n].*$", re.M)
# no tokenizer has this id: the ends of words while several are encoded
_NO_ID = 0xFFFFFFFF
_CUT = _NO_ID.to_bytes(4, "little")


def _plain_classes(pattern: str) -> str:
    """The pattern with its classes of letters and numbers as lists of the plain characters, small letters only."""
    plain = [c for c in map(chr, range(0x21, 0x180)) if re.match(f"[{_PLAIN}]", c) and c.lower() == c]
    for kind in "LN":
        pattern = pattern.replace(rf"\p{{{kind}}}", "".join(c for c in plain if unicodedata.category(c)[0] == kind))
    return pattern


def _word_pattern(definition: dict) -> str | None:
    """The pattern that keeps words, if normalizer and pre-tokenizer are the known ones."""
    normal = definition.get("normalizer") or {}
    before = definition.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or []
    if (
        [n.get("type") for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
    ):
        return steps[0]["pattern"].get("Regex")
    return None


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Only for tokenizers whose words end at white space and drop it (``word_bpe``): no
    step of theirs looks across ASCII white space, so the ids of a text are those of
    its words, one after the other. Special tokens in a text are found as the library
    does. The new words of some texts are encoded together: words of Latin letters are cut
    by one search, and each new part goes to the library's model; others go through all its steps.

    Words are kept in two generations of ``limit``: a word of the older one moves up when
    it is met again, so frequent words stay, and the rest goes with its generation.
    """

    def __init__(self, definition: str, limit: int = CACHED_WORDS):
        self.limit = limit
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        read = json.loads(definition)
        pattern = _word_pattern(read)
        # the ends of words are parts of their own
        self.find = re.compile(f"\\n|{_plain_classes(pattern)}").findall if pattern else None
        self.parts = {"\n": _CUT}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in read.get("added_tokens", [])) or "(?!)")
        self.model = self.tokenizer.model

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return array("I", [token.id for token in self.model.tokenize(part)]).tobytes()

    def make(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, without the cache."""
        joined = b"\n".join(words).decode("utf-8", "replace")
        texts = joined.split("\n")
        odd = set(_ODD.findall(joined)) if self.find else set(texts)
        odd.update(text for text in texts if self.special.search(text)) if self.special.search(joined) else None
        plain = [text for text in texts if text not in odd] if odd else texts
        made = iter(self._plain(plain))
        return [self._alone(text) if text in odd else next(made) for text in texts] if odd else list(made)

    def _alone(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        parts = self.find("\n".join(texts).lower())
        known = self.parts
        if len(known) > self.limit:
            known = self.parts = {"\n": _CUT}
        for part in set(parts).difference(known):
            known[part] = self._part(part)
        data = b"".join(map(known.__getitem__, parts))
        ends = np.append(np.flatnonzero(np.frombuffer(data, "<u4") == _NO_ID) * 4, len(data))
        starts = np.append(0, ends[:-1] + 4).tolist()
        return [data[a:b] for a, b in zip(starts, ends.tolist())]

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            words, sizes, size = [], [], 0
            while at < len(texts) and (not sizes or size < TEXT_BYTES):
                own = texts[at].split()
                words += own
                sizes.append(len(own))
                size += len(texts[at])
                at += 1
            yield from self._encoded(words, sizes)

    def _encoded(self, words: list[bytes], sizes: list[int]) -> Iterator[bytes]:
        """The ids of texts with so many words each; every distinct word is looked up once, and its ids are copied to its places."""
        coded = pa.array(words, pa.binary()).dictionary_encode()
        names, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(self.newer.get, names))
        missing = [i for i, found in enumerate(ids) if found is None]
        found = self._look_up(dict.fromkeys(names[i] for i in missing))
        for i in missing:
            ids[i] = found[names[i]]
        data = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(length) - length
        # the ids of a word lie at a distance from where they go that is the same for all of them
        times = length[code]
        ends = np.append(0, np.cumsum(times))
        out = data[np.repeat(first[code] - ends[:-1], times) + np.arange(ends[-1])]
        stops = ends[np.append(0, np.cumsum(sizes))].tolist()
        for a, b in zip(stops, stops[1:]):
            yield out[a:b].tobytes()

    def _look_up(self, words: dict[bytes, bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not in the newer generation; they are from now on."""
        new = []
        for word in words:
            ids = words[word] = self.older.get(word)
            if ids is None:
                new.append(word)
        for at in range(0, len(new), CALL_WORDS):
            words.update(zip(new[at : at + CALL_WORDS], self.make(new[at : at + CALL_WORDS])))
        if len(self.newer) + len(words) > self.limit:
            self.older, self.newer = self.newer, {}
        self.newer.update(item for item in words.items() if len(item[0]) <= CACHED_BYTES)
        return words

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))


def word_encoder(definition: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    """The worker's encoder for a tokenizer file's content; kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return hold(("words", definition, cached_words), lambda: WordEncoder(definition, cached_words))


def read_definition(path: str) -> str:
    """The tokenizer file, read where the job is planned; tasks get its content."""
    with open(path, encoding="utf-8") as file:
        return file.read()
