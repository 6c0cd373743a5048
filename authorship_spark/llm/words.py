"""A bounded memory of what each distinct pre-token gave, kept by a Python worker.

Texts repeat their words, so an encoder need only see each new word once. The
memory stops growing at ``limit`` words; later new words are encoded again for
each group of texts, which changes time but never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator


class WordMemory:
    """``encode`` maps a list of distinct words to their values, in order."""

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 400_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def texts(self, texts: Iterable[str], split: Callable[[str], list[str]], group: int = 1_500_000) -> Iterator[list]:
        """For each text the values of its words; ``group`` characters are held at a time."""
        held, size = [], 0
        for text in texts:
            held.append(split(text))
            size += len(text)
            if size >= group:
                yield from self._values(held)
                held, size = [], 0
        yield from self._values(held)

    def _values(self, held: list[list[str]]) -> Iterator[list]:
        known = self.known
        new = list(set().union(*held).difference(known)) if held else []
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        for words in held:
            yield list(map(known.__getitem__, words))
        if len(known) > self.limit:
            for word in new:
                del known[word]
