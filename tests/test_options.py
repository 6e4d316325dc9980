import pytest

from quire import options as O


@pytest.mark.parametrize(("spec", "pages"), [("5", {5}), ("1-3", {1, 2, 3}), ("1,3-5,10", {1, 3, 4, 5, 10}), (" 2 ,,3", {2, 3}), ("", set())])
def test_pages(spec, pages):
    assert O.parse_pages(spec) == pages


@pytest.mark.parametrize("spec", ["3-1", "0", "0-2", "-5", "abc", "1-2-3", "1,abc", "1-", "-", "1-abc", "1-1000001", "1-1000000,2000001-2000002"])
def test_bad_pages(spec):
    with pytest.raises(ValueError, match="pages"):
        O.parse_pages(spec)


def test_validators():
    assert O.positive_float("0.5") == 0.5 and O.dpi_setting("1200") == 1200 and O.worker_setting("0") == 0
    for check, raw in ((O.positive_float, "0"), (O.positive_float, "nan"), (O.positive_float, "inf"), (O.positive_megabytes, "1e-9"), (O.positive_int, "0"), (O.worker_setting, "257"), (O.dpi_setting, "1201")):
        with pytest.raises(ValueError):
            check(raw)
    assert O.check_correlation_id("a.b:c-9") == "a.b:c-9"
    for bad in ("", "a b", "x" * 65, "a\n"):
        with pytest.raises(ValueError):
            O.check_correlation_id(bad)


def test_options():
    assert not O.Options().forces_all_pages
    assert all(O.Options(**{k: v}).forces_all_pages for k, v in (("re_ocr", True), ("strip_text_layer", True), ("skip_verify", False), ("legal_codec_profile", "x")))
    assert O.Options(mode="fast", bg_codec="jpeg2000").effective_codec[0] == "jpeg" and O.Options(bg_codec="jpeg2000").effective_codec == ("jpeg2000", ())
    assert (O.Options(mode="fast").source_dpi, O.Options().source_dpi) == (200, 300)
    for wrong in ({"preserve_signatures": True, "allow_signed_invalidation": True}, {"mode": "slow"}):
        with pytest.raises(ValueError):
            O.Options(**wrong)


def test_workers_and_memory():
    assert [O.worker_count(0, 100, 8), O.worker_count(4, 2, 8), O.worker_count(0, 5, 1)] == [7, 2, 1]
    gib = 1 << 30
    assert O.worker_memory_cap(1, 1, None) == 8 * gib and O.worker_memory_cap(4 * gib, 1, None) == 16 * gib
    assert O.worker_memory_cap(1, 7, 32 * gib) == int(32 * gib * 0.7) // 7 and O.worker_memory_cap(1, 7, 32 * gib, 0) == 0


def test_password():
    assert [O.read_password("a\n\n", None), O.read_password("a\r\n", None), O.read_password(None, "e"), O.read_password("", "e")] == ["a\n", "a", "e", ""]
