"""Treaty terms besides layers: fronting, captives, coupons, layer capacity, reinstatements; as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _floored(x) -> Column:
    return F.greatest(F.lit(0.0), x)


def _share(x) -> Column:
    return F.least(F.lit(1.0), _floored(x))


def fronted(loss: Column, retention: Column) -> tuple[Column, Column]:
    """(kept, ceded) parts of a loss whose fronter keeps a share."""
    kept = _floored(loss) * _share(retention)
    return kept, _floored(loss) * (1 - _share(retention))


def fronting_fee(premium: Column, share: Column) -> Column:
    return _floored(premium) * _share(share)


def captive(total: Column, reserves: Column, collateral: Column, unearned: Column) -> dict[str, Column]:
    """Trapped and free capital of a captive, and the trapped share (at most 1; 0 without capital)."""
    trapped = _floored(reserves) + _floored(collateral) + _floored(unearned)
    share = F.when(_floored(total) > 0, F.least(F.lit(1.0), trapped / _floored(total))).otherwise(0.0)
    return {"trapped": trapped, "free": _floored(_floored(total) - trapped), "trapped_share": share}


def coupon(principal: Column, rate: Column) -> Column:
    """What a sponsor pays investors a year for a bond of that principal."""
    return _floored(principal) * _floored(rate)


def initial_capacity(attach: Column, exhaust: Column, reinstatements: Column) -> Column:
    return _floored(exhaust - attach) * (1 + F.greatest(F.lit(0), reinstatements))


def paid_by_layer(loss: Column, attach: Column, exhaust: Column, capacity: Column) -> tuple[Column, Column]:
    """(paid, capacity left) of one loss to a layer that can still pay so much."""
    paid = F.least(_floored(F.least(loss, exhaust) - attach), _floored(capacity))
    return paid, _floored(_floored(capacity) - paid)


def reinstatement_premium(paid: Column, width: Column, premium: Column, factor: Column) -> Column:
    """Premium to restore a layer, in proportion to what it paid; 0 for a layer without width."""
    return F.when(width > 0, _floored(paid) / width * _floored(premium) * _floored(factor)).otherwise(0.0)
