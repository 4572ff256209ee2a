"""How files are dealt to tasks: few large shares, but enough of them for all cores."""

from tallyframe.sources.adapters import Landed, dealt


def test_shares_follow_cores_and_not_small_bytes():
    files = [Landed(n, f"f{n:05d}", 8_000) for n in range(1_000)]
    shares = dealt(files, 64 << 20, 24)
    assert len(shares) == 24 and sorted(u for s in shares for u in s.urls) == [f.url for f in files]
    assert max(len(s.urls) for s in shares) <= 42
    assert len(dealt(files[:3], 64 << 20, 24)) == 3 and dealt([], 64 << 20, 24) == []
    assert len(dealt(files, 1 << 20, 2)) == 8
