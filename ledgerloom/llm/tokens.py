"""Token ids of a public tokenizer file, by the ``tokenizers`` library.

Ids of a text are the concatenation of the ids of its words, so each word goes
to the library once and its ids are kept.
"""

import re
import struct

from ledgerloom.llm.scratch import per_process

#: Anything but characters whose lower case, normal form and class every Unicode version agrees on.
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x84\x86-įı-ɏ]")
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+")
_SPACE = re.compile(r"[\x20\t\n\r]+")
#: Entries of a worker's table of words, of which a new one is begun when it is full; a worker keeps it from task to task.
_MOST = 300_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Ids of words without white space, all of them plain and in lower case."""

    def __init__(self, library) -> None:
        self.model, self.letters = library.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _MOST:
            self.clear()
        if word.isalpha():
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = _packed([t.id for t in self.model.tokenize(mapped)])
        elif word[:-1].isalpha() and word[-1] in ".,":
            ids = self[word[:-1]] + self[word[-1]]
        elif len(parts := _PRE.findall(word)) > 1:
            ids = b"".join(map(self.__getitem__, parts))
        else:
            ids = _packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])
        self[word] = ids
        return ids


class _Chunks(dict):
    """Ids of any other chunk, by the whole tokenizer."""

    def __init__(self, library) -> None:
        self.library = library

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _MOST:
            self.clear()
        self[chunk] = ids = _packed(self.library.encode(chunk, add_special_tokens=False).ids)
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Ids of whole texts under a byte-pair file that lower-cases and drops white space, as unsigned 32-bit little-endian bytes.

    A chunk between ASCII white space that holds a special token's string or a
    character outside plain Latin goes to the library as it is.
    """

    def __init__(self, path: str) -> None:
        def make():
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            special = [t.content for t in library.get_added_tokens_decoder().values()]
            return _Words(library), _Chunks(library), special

        self.words, self.chunks, self.special = per_process(f"tokenizer {path}", make)

    def _plain(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(s in text for s in self.special)

    def __call__(self, text: str) -> bytes:
        word = self.words.__getitem__
        if self._plain(text):
            return b"".join(map(word, text.lower().split()))
        out = []
        for chunk in _SPACE.split(text):
            if self._plain(chunk):
                out.extend(map(word, chunk.lower().split()))
            else:
                out.append(self.chunks[chunk])
        return b"".join(out)


#: The expression by which byte-level files cut texts (fixed by the format).
_BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that the quicker matcher might give up on.
_RUN = re.compile(r"\s{999}|\S{9999}")


class ByteTokenizer:
    """Ids of whole texts under a byte-level file without a normaliser or prefix space, as unsigned 32-bit little-endian bytes.

    Where the file's merges rank as its ids do, ``tiktoken`` reads plain Latin texts with
    the file's own vocabulary, several times as fast; any other text goes to ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        def make():
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            return library, [t.content for t in library.get_added_tokens_decoder().values()], _ranked(path)

        self.library, self.special, self.quick = per_process(f"tokenizer {path}", make)

    def __call__(self, text: str) -> bytes:
        if self.quick is None or _OTHER.search(text) or _RUN.search(text) or any(s in text for s in self.special):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return _packed(self.quick.encode_ordinary(text))


def _ranked(path: str):
    """The vocabulary of a file as ranks, or None where merges don't rank as ids do."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in made or made != sorted(made):
        return None
    back = {letter: byte for byte, letter in _byte_letters().items()}
    ranks = {bytes(back[c] for c in token): k for token, k in model["vocab"].items() if all(c in back for c in token)}
    return tiktoken.Encoding("byte-level", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
