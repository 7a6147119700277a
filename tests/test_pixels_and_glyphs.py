import numpy as np
import pytest

from hillstream.functions import glyphs, pixels
from hillstream.functions.image import digit_similarity

#: Figures of five by seven points.
FIGURES = {
    "0": "01110 10001 10001 10001 10001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110", "2": "01110 10001 00001 00110 01000 10000 11111",
    "3": "11110 00001 00001 01110 00001 00001 11110", "4": "00010 00110 01010 10010 11111 00010 00010", "5": "11111 10000 11110 00001 00001 10001 01110",
    "6": "00110 01000 10000 11110 10001 10001 01110", "7": "11111 00001 00010 00100 01000 01000 01000", "8": "01110 10001 10001 01110 10001 10001 01110", "9": "01110 10001 10001 01111 00001 00010 01100",
}


def figure(d, scale=4):
    return np.kron(np.array([[c == "1" for c in row] for row in FIGURES[d].split()]), np.ones((scale, scale), dtype=bool))


def written(number, scale=4, gap=6):
    parts = [np.zeros((7 * scale, gap), dtype=bool)]
    for d in number:
        parts += [figure(d, scale), np.zeros((7 * scale, gap), dtype=bool)]
    return np.pad(np.concatenate(parts, axis=1), 4)


def cut(mask):
    return glyphs.segments(np.pad(mask, 3))[0]


TEMPLATES = {d: [cut(figure(d))] for d in FIGURES}


def test_grey_and_colours():
    bgr = np.array([[[0, 0, 255], [255, 0, 0], [0, 255, 0], [255, 255, 255], [0, 0, 0], [0, 255, 255]]], dtype=np.uint8)
    assert pixels.grey(bgr).tolist() == [[76, 29, 150, 255, 0, 226]]
    assert pixels.hsv(bgr).tolist() == [[[0, 255, 255], [120, 255, 255], [60, 255, 255], [0, 0, 255], [0, 0, 0], [30, 255, 255]]]
    assert pixels.in_range(pixels.hsv(bgr), (18, 110, 170), (40, 255, 255)).tolist() == [[False] * 5 + [True]]


def test_blur_keeps_flat_images_and_spreads_points():
    assert (pixels.blurred(np.full((4, 5), 77, dtype=np.uint8)) == 77).all()
    point = np.zeros((5, 5), dtype=np.uint8)
    point[2, 2] = 160
    assert pixels.blurred(point)[1:4, 1:4].tolist() == [[10, 20, 10], [20, 40, 20], [10, 20, 10]]
    assert pixels.blurred(np.array([[9]], dtype=np.uint8)).tolist() == [[9]] and pixels.blurred(np.zeros((0, 3), dtype=np.uint8)).size == 0


def test_otsu_against_all_thresholds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = np.concatenate([rng.normal(60, 15, 200), rng.normal(170, 20, 120)]).clip(0, 255).astype(np.uint8).reshape(16, 20)
        def between(t, x=x):
            a, b = x[x <= t], x[x > t]
            return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0
        best = max(map(between, range(256)))
        assert between(pixels.otsu(x)) == pytest.approx(best)
    assert pixels.otsu(np.full((3, 3), 9, dtype=np.uint8)) == 0
    x = np.array([[10, 10, 200, 200]], dtype=np.uint8)
    assert pixels.parted(x).tolist() == [[False, False, True, True]] and not pixels.parted(x, 250).any()


def test_scaling():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    assert (pixels.nearest(x, 4, 3) == x).all() and (pixels.cubic(x, 4, 3) == x).all()
    assert pixels.nearest(x, 2, 3).tolist() == x[:, ::2].tolist() and (pixels.nearest(x, 8, 6)[::2, ::2] == x).all()
    assert (pixels.cubic(np.full((5, 4), 123, dtype=np.uint8), 9, 11) == 123).all()
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (4, 1))
    wide = pixels.cubic(ramp, 40, 4)[0].astype(int)
    assert (np.diff(wide) >= 0).all() and abs(wide[20:24] - np.array([97.5, 102.5, 107.5, 112.5])).max() <= 1


def test_components_and_holes():
    x = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], dtype=bool)
    assert [len(c) for c in pixels.components(x)] == [2, 2, 2] and [len(c) for c in pixels.components(x, eight=False)] == [1, 2, 1, 2]
    ring = np.ones((5, 5), dtype=bool)
    ring[2, 2] = False
    assert pixels.hole_areas(ring) == [2.0]
    ring = np.ones((6, 6), dtype=bool)
    ring[2:4, 2:4] = False
    assert pixels.hole_areas(ring) == [7.0] and pixels.hole_areas(~ring) == [] and pixels.hole_areas(np.zeros((3, 3), dtype=bool)) == []
    assert [sum(a >= 4 for a in pixels.hole_areas(figure(d))) for d in "0123456789"] == [1, 0, 0, 0, 1, 0, 1, 0, 2, 1]


def test_edges():
    step = np.zeros((20, 20), dtype=np.uint8)
    step[:, 10:] = 200
    found = pixels.edges(step)
    assert found.any(axis=1).all() and set(np.flatnonzero(found.any(axis=0))) <= {9, 10} and not pixels.edges(np.full((9, 9), 50, dtype=np.uint8)).any()
    faint = np.zeros((20, 20), dtype=np.uint8)
    faint[:, 10:] = 20
    assert not pixels.edges(faint).any() and pixels.edges(faint.T + step).any()
    assert pixels.activity(step)[:, 11:].all()


def test_views():
    bgr = np.zeros((10, 10, 3), dtype=np.uint8)
    bgr[2:4, 2:8], bgr[6:8, 2:8] = (26, 26, 214), (255, 165, 61)
    views = pixels.reading_views(bgr)
    assert {k: v.shape for k, v in views.items()} == dict.fromkeys(("grayscale", "red", "blue", "yellow"), (20, 20))
    assert views["red"].sum() == 48 and views["red"][4:8, 4:16].all() and views["blue"][12:16, 4:16].all() and not views["yellow"].any()


def test_board():
    rng = np.random.default_rng(3)
    template = rng.integers(0, 255, (8, 12)).astype(np.uint8)
    header = np.repeat(np.repeat(template, 3, 0), 3, 1)[..., None].repeat(3, 2)
    assert pixels.correlation(template, template) == pytest.approx(1) and pixels.correlation(255 - template, template) == pytest.approx(-1)
    assert pixels.correlation(np.full((4, 4), 7, dtype=np.uint8), template) == 0
    area = np.zeros((10, 10, 3), dtype=np.uint8)
    area[0, :4] = 250
    assert pixels.shows_board(area, header, template) and not pixels.shows_board(area, 255 - header, template)
    assert not pixels.shows_board(area, header, None) and not pixels.shows_board(np.zeros((10, 10, 3), dtype=np.uint8), header, template)


def test_shapes():
    s = glyphs.shape_of(TEMPLATES["7"][0])
    assert s.holes == 0 and s.upper > s.lower and s.drift < -0.045 and s.upper + s.lower == pytest.approx(1) and s.left + s.right == pytest.approx(1)
    assert glyphs.shape_of(np.zeros((4, 4), dtype=bool)) == glyphs.Shape()
    assert glyphs.shape_bonus("7", s) == pytest.approx(0.015 + 0.055) and glyphs.shape_bonus("8", glyphs.Shape(holes=2, drift=0.1)) == pytest.approx(0.055)
    assert glyphs.shape_bonus("1", glyphs.Shape()) == pytest.approx(0.015 + 0.05) and glyphs.width_ratio(figure("1")) == pytest.approx(3 / 7)


def test_segments_keep_the_largest_figures():
    assert [len(glyphs.segments(written(n))) for n in ("7", "42", "250", "1234")] == [1, 2, 3, 3]
    assert glyphs.segments(np.zeros((0, 4), dtype=bool)) == [] and glyphs.segments(np.zeros((9, 9), dtype=bool)) == []
    bar = written("42")
    bar[:, 0] = True  # thin, at the left edge
    assert len(glyphs.segments(bar)) == 2


@pytest.mark.parametrize("number", ["0", "7", "42", "90", "138", "176", "250"])
def test_scores(number):
    text, mean = glyphs.read_score(written(number), TEMPLATES)
    assert text == number and 0.9 < mean < 1.2


def test_scores_are_legal():
    assert glyphs.read_score(written("987"), TEMPLATES)[0] != "987" and glyphs.read_score(written("42"), {}) == (None, 0.0)
    assert glyphs.legal_digits("", 3) == "12" and glyphs.legal_digits("2", 3) == "012345" and glyphs.legal_digits("25", 3) == "0" and glyphs.legal_digits("2", 2) == "0123456789"
    assert glyphs.read_score(written("42"), TEMPLATES, least=1.5)[0] is None


def test_artifacts():
    thin = np.zeros((24, 18), dtype=bool)
    thin[:, 8:10] = True
    some = [thin, *TEMPLATES["4"], *TEMPLATES["2"]]
    like = glyphs.ranked_digits(thin, TEMPLATES)[0][1]
    assert len(glyphs.without_artifact(some, TEMPLATES, 0.0, 0.2, like + 0.01)) == 2 and len(glyphs.without_artifact(some, TEMPLATES, 0.0, 0.2, like - 0.01)) == 3
    assert len(glyphs.without_artifact(some, TEMPLATES, 0.5, 0.0, 0.0)) == 2 and len(glyphs.without_artifact(some[:2], TEMPLATES, 1.0, 1.0, 1.0)) == 2


def test_ranking():
    for d in FIGURES:
        assert glyphs.ranked_digits(TEMPLATES[d][0], TEMPLATES)[0][0] == d and digit_similarity(TEMPLATES[d][0], TEMPLATES[d][0]) == pytest.approx(1)
    assert {d for d, _ in glyphs.ranked_digits(TEMPLATES["3"][0], TEMPLATES, "12")} == {"1", "2"}


def picture(mask, on=230, off=20):
    return np.where(mask[..., None], on, off).astype(np.uint8).repeat(3, axis=2)


def test_crops():
    crop = glyphs.score_crop(picture(written("42")))
    assert glyphs.read_score(crop, TEMPLATES)[0] == "42" and not crop[:, :2].any()
    t = glyphs.template(255 - picture(np.pad(figure("8"), 4))[..., 0])
    assert t.shape == (24, 18) and t.mean() < 0.55


@pytest.mark.parametrize("digit", ["0", "1"])
def test_counters(digit):
    mask = glyphs.counter_crop(picture(np.pad(figure(digit), 5)))
    value, score = glyphs.read_counter(mask)
    assert value == int(digit) and score >= 0.6
    assert glyphs.read_counter(np.zeros((24, 18), dtype=bool)) == (None, 0.0)
    assert glyphs.read_counter(mask, glyphs.CounterRules(margin=2.0))[0] is None


def test_lit():
    orange = np.full((4, 4, 3), (0, 90, 255), dtype=np.uint8)
    assert glyphs.is_lit(orange) == (True, 1.0)
    orange[:2] = 0
    assert glyphs.is_lit(orange) == (False, 0.5) and glyphs.is_lit(orange[:0]) == (False, 0.0)
