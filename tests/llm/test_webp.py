"""Stored payloads go through the codec: transforms, own codes, back-references, and one decoder for all files."""

import numpy as np
import pytest

from helixbin.llm import webp


def stored(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    return webp.store(data, np.cumsum([0, *map(len, texts)]))


def first_transform(file):
    """Kind of the first transform of a file, None if it has none."""
    bits = webp._chunk(file)[5]
    return bits >> 1 & 3 if bits & 1 else None


def two_transforms(file):
    """Kinds of the first transforms of a file whose first one is subtract-green."""
    bits = webp._chunk(file)[5]
    return [k for k in (bits >> 1 & 3, bits >> 4 & 3) if bits & 8 or k == bits >> 1 & 3]


def samples(rng):
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n)).encode()
    ramp = bytes(((np.arange(9000) // 3 + rng.integers(0, 3, 9000)) % 256).astype(np.uint8))
    return [b"", b"a", prose(5), prose(400), prose(3000), b"x" * 9000, b"ab\n" * 50, b"\0" * 64, bytes(range(256)) * 9, ramp, rng.bytes(5000), prose(900) * 2]


def test_every_stored_file_is_read_by_the_decoder_and_has_transforms():
    """One fixed code without transforms or matches was written, and read by a decoder of its own."""
    texts = samples(np.random.default_rng(3))
    files = stored(texts)
    for text, file, image in zip(texts, files, webp.load(files)):
        payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
        rgba = webp.decode(file)
        assert image.tobytes()[: len(payload)] == payload and (rgba[..., 1] == image).all()
        assert (rgba[..., 0] == image).all() and (rgba[..., 2] == image).all() and (rgba[..., 3] == 255).all()
        assert first_transform(file) == (3 if len(set(payload + image.tobytes())) <= 16 else 2)
    assert stored(texts[::-1]) == files[::-1]  # whatever stands beside them
    ramp, twice, prose = files[9], files[11], files[3]
    assert two_transforms(ramp) == [2, 0] and len(ramp) < 0.6 * len(texts[9])  # predictors
    assert len(twice) < 0.75 * len(stored([texts[11][: len(texts[11]) // 2]])[0]) * 2  # a match across half the text
    assert len(prose) < 0.75 * len(texts[3])


def test_widths_of_long_texts():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 40, 1_100_000).astype(np.uint8).tobytes() + b"y" * 5000
    file = stored([text, b"short"])[0]
    image = webp.load([file])[0]
    assert image.shape[1] == 2048 and image.tobytes()[: len(text)] == text
    with pytest.raises(ValueError):
        webp.sides(webp.MAX_SIDE**2 + 64)


@pytest.mark.parametrize("cut", [30, 60, 200])
def test_cut_files_are_refused(cut):
    file = stored([np.random.default_rng(5).bytes(3000)])[0]
    with pytest.raises(ValueError):
        webp.decode(file[:cut])


def test_predictors_on_whole_rows_equal_those_of_one_pixel():
    rng = np.random.default_rng(6)
    near = rng.integers(0, 1 << 32, (4, 500), dtype=np.uint32)
    got = webp._predictions(*near)
    for mode in range(14):
        assert got[mode].tolist() == [webp.predicted(mode, *p) for p in zip(*near.tolist())]
