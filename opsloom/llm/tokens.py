"""Token ids of whole texts by the tokenizers library, with a memory of the words met before.

A byte-level BPE splits a text into words first and encodes each alone.  In this
family of tokenizers a word never spans a single space that follows or precedes
something else than white space, so a text may be cut in front of such spaces and
the parts encoded one by one; equal parts have equal ids.  A line feed between two signs
that are no white space is a word of its own, so a text is cut in front of it too.  Arrow cuts the
texts of a call and numbers their different parts, so each is looked up once a call.  Parts of
plain letters are one word each and skip the library's search for words.  Each Python worker keeps
the ids of up to ``MEMORY`` parts, about 150 bytes each, and starts anew when that many
are kept, so its memory is bounded.  Texts with other white space around a space, and texts that hold an added
token such as <|endoftext|>, go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from opsloom.llm.held import held

#: Parts of which a worker keeps the ids.
MEMORY = 700_000
#: Longer parts are encoded, but not kept.
LONGEST_KEPT = 64
#: Parts whose ids are copied to their places at once.
SLICE = 1 << 18
_SPACES = re.compile(r"\s\s")


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a tokenizer file, with what it has learned so far."""
    return held(f"encoder {path}", lambda: Encoder(path))


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        added = [token.content for token in self.library.get_added_tokens_decoder().values() if token.content]
        #: Finds an added token, which the library takes out of a text before it splits words.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        vocabulary = self.library.get_vocab()
        #: Whether a token starts with a space, which the byte alphabet writes as U+0120.
        self.opens = np.zeros(size, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        #: The library with the same model for words given in its byte alphabet, without a search for words.
        self.bare = None
        if isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel) and self.library.normalizer is None:
            self.bare = Tokenizer(self.library.model)
            self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        #: Whether a token is the line feed, which is written as U+010A.
        self.feeds = np.zeros(size, bool)
        self.feeds[[i for token, i in vocabulary.items() if token == "Ċ"]] = True
        self.kept: dict[str, bytes] = {}
        self.marks = {mark: self.whole(mark).tobytes() for mark in ",."}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _holds_added(self, text: str) -> bool:
        return self.added is not None and self.added.search(text) is not None

    def _learn(self, parts: list[str], lead: str = " ", bare: bool = False, width: int = 128) -> dict[str, bytes]:
        """Ids of parts that hold no white space and follow a space or a line feed, many joined to a line at a time."""
        known: dict[str, bytes] = {}
        groups = [parts[i : i + width] for i in range(0, len(parts), width)]
        joined = ["Ġ" + " Ġ".join(group) if bare else lead + lead.join(group) for group in groups]
        size, begins = self.kind.itemsize, self.feeds if lead == "\n" else self.opens
        for group, text, line in zip(groups, joined, (self.bare if bare else self.library).encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(line.ids, self.kind)
            bounds = (np.append(np.flatnonzero(begins[ids]), len(ids)) * size).tolist()
            # a part with a sign that the alphabet writes alike, or an added token across parts
            if len(bounds) != len(group) + 1 or self._holds_added(text):
                known |= self._learn(group, lead, width=width // 8) if width > 8 else {part: self.whole(lead + part).tobytes() for part in group}
                continue
            data = ids.tobytes()
            known.update(zip(group, [data[i:j] for i, j in zip(bounds, bounds[1:])]))
        return known

    def _fresh(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of the parts that are not kept; a comma or full stop after a letter is a word of its own."""
        letters: set[str] = set()
        odd, ends, lines, plain = [], [], [], []
        for part in missing:
            if not part or not part.isprintable():
                (lines if len(part) > 1 and part[0] == "\n" and part[1:].isprintable() else odd).append(part)
            elif part.isalpha():
                letters.add(part)
            elif part[-1] in ",." and part[:-1].isalpha():
                ends.append(part)
            else:
                plain.append(part)
        stems: dict[str, bytes] = {}
        for part in ends:
            stem = part[:-1]
            if (ids := self.kept.get(stem)) is not None:
                stems[stem] = ids
            else:
                letters.add(stem)
        bare = [part for part in letters if part.isascii()] if self.bare else []
        known = self._learn(bare, bare=True)
        known |= stems
        known |= self._learn([*plain, *letters.difference(bare)])
        for part in ends:
            known[part] = known[part[:-1]] + self.marks[part[-1]]
        known.update(("\n" + part, ids) for part, ids in self._learn([part[1:] for part in lines], "\n").items())
        for part, line in zip(odd, self.library.encode_batch_fast([part if part[:1] == "\n" else " " + part for part in odd], add_special_tokens=False)):
            known[part] = np.array(line.ids, self.kind).tobytes()
        return known

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text is an empty one."""
        out: list[np.ndarray] = []
        rests: list[str | None] = []
        cut: list[int] = []
        for text in texts:
            if not text or _SPACES.search(text) or text[0] == " " or self._holds_added(text):
                out.append(self.whole(text) if text else np.zeros(0, self.kind))
                continue
            first, space, rest = text.replace("\n", " \n").partition(" ")
            cut.append(len(out))
            rests.append(rest if space else None)
            out.append(self.whole(first))
        for i, ids in zip(cut, self._parts(rests)):
            out[i] = np.concatenate([out[i], ids])
        return out

    def _parts(self, rests: list[str | None]) -> list[np.ndarray]:
        """The ids of texts that are cut at each space; a null one has no part."""
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        parts = lists.values.dictionary_encode()
        names, at = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        found = [*map(self.kept.get, names)]
        fresh = self._fresh([name for name, ids in zip(names, found) if ids is None])
        found = [fresh[name] if ids is None else ids for name, ids in zip(names, found)]
        self._keep(fresh)
        pool = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        ends = np.append(0, np.cumsum(sizes[at]))
        ids = np.empty(int(ends[-1]), self.kind)
        for i in range(0, len(at), SLICE):
            some = at[i : i + SLICE]
            low, high = int(ends[i]), int(ends[i + len(some)])
            ids[low:high] = pool[np.repeat(starts[some] - ends[i : i + len(some)], sizes[some]) + np.arange(low, high)]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]

    def _keep(self, fresh: dict[str, bytes]) -> None:
        if len(self.kept) + len(fresh) > MEMORY:
            self.kept.clear()
        short = max(map(len, fresh), default=0) <= LONGEST_KEPT
        self.kept.update(fresh if short else ((part, ids) for part, ids in fresh.items() if len(part) <= LONGEST_KEPT))
