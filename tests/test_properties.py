"""Property tests (no Spark) for the driver-side helpers."""

from hypothesis import given
from hypothesis import strategies as st

from tierwise.operators.schema import find_common_key
from tierwise.operators.split import allocate, sample_quotas, split_quotas


@given(st.dictionaries(st.integers(0, 5), st.integers(0, 1000), min_size=1), st.integers(0, 100))
def test_allocate_is_exact_and_fair(counts, pct):
    n = sum(counts.values())
    draw = n * pct // 100
    q = allocate(counts, draw)
    assert sum(q.values()) == (draw if n else 0)
    for k, c in counts.items():
        exact = c * draw / n if n else 0
        assert 0 <= q[k] <= c
        assert abs(q[k] - exact) < 1.0 + 1e-9


@given(st.dictionaries(st.integers(0, 3), st.integers(1, 500), min_size=1))
def test_split_quota_is_ceil_twenty_percent(counts):
    n = sum(counts.values())
    q = split_quotas(counts, 20)
    assert sum(q.values()) == -(-n * 20 // 100)
    assert sum(sample_quotas(counts, 25).values()) == n * 25 // 100


names = st.text(alphabet="abcXYZ_", min_size=1, max_size=4)


@given(st.lists(names, max_size=6), st.lists(names, max_size=6))
def test_common_key_is_first_shared_name(a, b):
    ka, kb = find_common_key(a, b)
    shared = [c for c in a if c.lower() in {x.lower() for x in b}]
    if not shared:
        assert (ka, kb) == (None, None)
    else:
        assert ka == shared[0]
        assert kb.lower() == ka.lower() and kb in b
