"""Compressed sizes under raw-content zstandard dictionaries, which the two compression classifiers share."""

from __future__ import annotations

import zstandard


def slice_of(data: bytes, size: int) -> bytes:
    """A slice of a training text, from its middle."""
    start = max(0, (len(data) - size) // 2)
    return data[start : start + size]


def raw_dictionary(samples: list[bytes], size: int) -> bytes:
    """Training slices of one class, joined and cut to the dictionary's size."""
    return b"\n".join(samples)[:size]


class Sizer:
    """The size of a whole text when each chunk of it is compressed on its own against one dictionary.

    Short chunks keep the dictionary the main source of matches; a long text would otherwise soon be its own dictionary.
    """

    def __init__(self, dictionary: bytes, chunk: int, level: int = 0, **parameters):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        if level:
            p = {"level": level}
        else:
            p = {"compression_params": zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **parameters)}
        d.precompute_compress(**p)
        self.compress, self.chunk = zstandard.ZstdCompressor(dict_data=d, **p).compress, chunk

    def __call__(self, data: bytes) -> int:
        return sum(len(self.compress(data[i : i + self.chunk])) for i in range(0, len(data), self.chunk))
