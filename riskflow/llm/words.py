"""Words of whole texts in pieces of bounded size."""

import re

_BLANK = re.compile(rb"[\x09-\x0d\x20]")
PIECE = 1 << 20


def word_lists(data: bytes, size: int = PIECE):
    """Lists of the words of `data` (runs without ASCII white space), in order; a list covers about `size` bytes."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > size and (found := _BLANK.search(data, at + size)):
            end = found.end()
        yield (data if end - at == len(data) else data[at:end]).split()
        at = end


def shingle_lists(data: bytes, n: int, size: int = PIECE):
    """Lists of at least `n` words that together hold every run of `n` words once; one shorter list if there are fewer."""
    held, whole = [], True
    for words in word_lists(data, size):
        held += words
        if len(held) >= n:
            yield held
            held, whole = held[len(held) - n + 1:], False
    if held and whole:
        yield held
