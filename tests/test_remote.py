"""Downloads that fail, and listings by page."""

import pytest

from gridloom.sources import remote


def test_downloads(tmp_path):
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if url == "gone":
            raise remote.Refused(404, "not found")
        yield b"ab"
        if url == "broken" or (url == "shaky" and len(calls) < 3):
            raise ConnectionError("reset")
        yield b"cd"

    get = lambda url: remote.download(fetch, url, f"{tmp_path}/d/{url}", sleep=waits.append)
    assert get("shaky") == 4 and (tmp_path / "d/shaky").read_bytes() == b"abcd" and waits == [10.0, 20.0]
    calls.clear()
    with pytest.raises(remote.Refused):
        get("gone")
    assert calls == ["gone"]
    with pytest.raises(ConnectionError):
        get("broken")
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["shaky"]


def test_listing(spark):
    pages = [[("a", 1), ("b", 2)], [("b", 3), ("c", 4)], []]
    assert {(r["path"], r["size"]) for r in remote.listing(spark, pages.__getitem__).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    with pytest.raises(ValueError, match="more than"):
        remote.listing(spark, lambda n: [("a", n)], 3)
