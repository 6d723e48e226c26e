from shelfcast.operators import elasticity as el


def _lines(make_sales, prices, qty=1):
    q = qty if isinstance(qty, list) else [qty] * len(prices)
    return make_sales([("S", "2024-01-01", "a", "m", "g", p, qi, p * qi) for p, qi in zip(prices, q)])


def _bins(s):
    b = el.price_bins(s).groupBy("price_bin").agg({"lines": "sum"}).collect()
    return {r[0]: r[1] for r in b}


def test_terciles(make_sales):
    assert _bins(_lines(make_sales, list(range(1, 11)))) == {"low": 4, "mid": 3, "high": 3}


def test_halves(make_sales):
    assert _bins(_lines(make_sales, [1] * 5 + [2] * 5)) == {"low": 5, "high": 5}


def test_skip(make_sales):
    assert _bins(_lines(make_sales, [1] * 8 + [2, 3])) == {}


def test_too_few_lines(make_sales):
    assert _bins(_lines(make_sales, list(range(1, 10)))) == {}


def test_zero_low_bin_undefined(make_sales):
    s = _lines(make_sales, list(range(1, 11)), [0, 0, 0, 0, 1, 1, 1, 2, 2, 2])
    r = el.price_elasticity(el.price_bins(s)).collect()[0]
    assert r.elasticity is None and r.elasticity_class == "undefined"


def test_elasticity_value(make_sales):
    s = _lines(make_sales, list(range(1, 11)), [4, 4, 4, 4, 2, 2, 2, 1, 1, 1])
    r = el.price_elasticity(el.price_bins(s)).collect()[0]
    low_p, high_p = 2.5, 9.0
    pc = (high_p - low_p) / low_p * 100
    qc = (3 - 16) / 16 * 100
    assert abs(r.elasticity - qc / pc) < 1e-12 and r.elasticity_class == "inelastic"
