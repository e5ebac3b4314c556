"""SQL text of plane geometry, for checking: every function returns an expression over the names of eight coordinates."""

from __future__ import annotations


def length(s: str) -> str:
    return f"sqrt(({s}x2-{s}x1)*({s}x2-{s}x1)+({s}y2-{s}y1)*({s}y2-{s}y1))"


def angle(a: str, b: str) -> str:
    cos = f"((({a}x2-{a}x1)*({b}x2-{b}x1)+({a}y2-{a}y1)*({b}y2-{b}y1))/({length(a)}*{length(b)}))"
    deg = f"(acos(greatest({cos},-1.0))*180/pi())"
    return f"(CASE WHEN {cos} > 1 THEN 0 WHEN {deg} >= 90 THEN 180-{deg} ELSE {deg} END)"


def point(x: str, y: str, s: str) -> str:
    t = f"least(1.0,greatest(0.0,(({x}-{s}x1)*({s}x2-{s}x1)+({y}-{s}y1)*({s}y2-{s}y1))/(({s}x2-{s}x1)*({s}x2-{s}x1)+({s}y2-{s}y1)*({s}y2-{s}y1))))"
    return f"sqrt(pow({x}-({s}x1+{t}*({s}x2-{s}x1)),2)+pow({y}-({s}y1+{t}*({s}y2-{s}y1)),2))"


def crosses(a: str, b: str) -> str:
    d = f"(({b}x2-{b}x1)*({a}y2-{a}y1)-({b}y2-{b}y1)*({a}x2-{a}x1))"
    s = f"((({a}x2-{a}x1)*({b}y1-{a}y1)+({a}y2-{a}y1)*({a}x1-{b}x1))/{d})"
    t = f"((({b}x2-{b}x1)*({a}y1-{b}y1)+({b}y2-{b}y1)*({b}x1-{a}x1))/(-{d}))"
    return f"({d} >= 0.0001 AND {s} BETWEEN 0 AND 1 AND {t} BETWEEN 0 AND 1)"


def distance(a: str, b: str) -> str:
    ends = ",".join([point(f"{a}x{k}", f"{a}y{k}", b) for k in (1, 2)] + [point(f"{b}x{k}", f"{b}y{k}", a) for k in (1, 2)])
    return f"(CASE WHEN {crosses(a, b)} THEN 0.0 ELSE least({ends}) END)"


def overshoot(a: str, b: str) -> str:
    p, q = (f"((({b}x{k}-{a}x1)*({a}x2-{a}x1)+({b}y{k}-{a}y1)*({a}y2-{a}y1))/(({a}x2-{a}x1)*({a}x2-{a}x1)+({a}y2-{a}y1)*({a}y2-{a}y1)))" for k in (1, 2))
    return f"(CASE WHEN least({p},{q}) > 1 THEN least({p},{q})-1 WHEN greatest({p},{q}) < 0 THEN -greatest({p},{q}) ELSE 0 END)"


def beside(s: str, x: str, y: str) -> str:
    return f"((-({s}y2-{s}y1)*({x})+({s}x2-{s}x1)*({y}))/{length(s)} >= 0)"


def prefixed(table: str, prefix: str, *more: str) -> str:
    return f"SELECT {', '.join([*more, *(f'{c} AS {prefix}{c}' for c in ('x1', 'y1', 'x2', 'y2'))])} FROM {table}"
