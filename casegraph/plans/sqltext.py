"""Pieces of SQL shared by the query texts."""


def sig(x: str, mid: float, slope: float) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({slope}::DOUBLE) * (({x}) - ({mid}::DOUBLE)))))"


def clamp4(x: str) -> str:
    return f"round(least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE), 4)"
