"""Lossless WebP: every choice of the format survives a round trip."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from stratanet.llm import media, webp

RNG = np.random.default_rng(1)
PICTURE = RNG.integers(0, 256, (9, 13, 4)).astype("u1")
PICTURE[2:5] = PICTURE[0]
CHOICES = {
    "plain": {},
    "green": {"steps": [(webp.SUBTRACT_GREEN, None)]},
    "predictor": {"steps": [(webp.PREDICTOR, RNG.integers(0, 14, (3, 4)))]},
    "cross": {"steps": [(webp.CROSS_COLOUR, RNG.integers(-128, 128, (3, 4, 3)))]},
    "all": {
        "steps": [
            (webp.PREDICTOR, RNG.integers(0, 14, (3, 4))),
            (webp.CROSS_COLOUR, RNG.integers(-128, 128, (3, 4, 3))),
            (webp.SUBTRACT_GREEN, None),
        ]
    },
    "cache": {"cache_bits": 4},
    "groups": {"groups": RNG.integers(0, 3, (3, 4)), "cache_bits": 2},
}


@pytest.mark.parametrize("choice", CHOICES)
def test_round_trip(choice):
    assert (webp.decode(webp.encode_image(PICTURE, **CHOICES[choice])) == PICTURE).all()


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    modes = np.full((3, 4), mode)
    assert (webp.predicted(webp.predicted(PICTURE, modes, 2, False), modes, 2, True) == PICTURE).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 5, 16, 17, 200])
def test_palettes(colours):
    palette = np.unique(RNG.integers(0, 256, (colours, 4)).astype("u1"), axis=0)
    picture = palette[RNG.integers(0, len(palette), (6, 11))]
    assert (webp.decode(webp.encode_image(picture, [(webp.PALETTE, palette)])) == picture).all()


def test_short_distances():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)
    assert webp.near(1, 64) == 64 and webp.near(2, 64) == 1 and webp.near(121, 64) == 1


def test_a_broken_file_is_refused():
    with pytest.raises(ValueError):
        webp.decode(b"RIFF....WEBPVP8 ....")
    with pytest.raises(ValueError):
        webp.decode(webp.store(b"abc\n" * 16)[:30] + bytes(10))


def test_samples_of_all_lengths():
    for n in (1, 2, 50):
        for data in (bytes(64 * n), bytes(range(64)) * n, b"line of text that comes again\n" * 32 * n):
            assert webp.load(webp.store(data)) == data
    large = RNG.integers(97, 123, webp.PART + 640).astype("u1").tobytes()
    assert webp.load(webp.store(large)) == large


def test_odd_rows(odd, none):
    rows = media.described(media.stored_media(odd)).collect()
    want = []
    for r in odd.collect():
        data = (r.text or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        want.append((r.doc_id or 0, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    got = [(r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows]
    assert sorted(got) == sorted(want)
    assert len({r.media_sha256 for r in rows if r.doc_id in (1, 2)}) == 1
    assert media.described(media.stored_media(none)).count() == 0
