"""Shapes of a drawn diagram: one fold over the markup's events that carries offset and style down the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple
from xml.parsers import expat

# Numbers of arguments of path commands, and the forms of numbers, rules and offsets.
ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
PATH_TOKEN = r"[A-Za-z]|-?(?:\d+\.?\d*|\.\d+)(?:e-?\d+)?"
PLAIN_NUMBER = r"-?[\d.]+"
TRANSLATE = re.compile(r"\s*translate\(\s*(-?[\d.]+)[\s,]*(-?[\d.]+)?\s*\)\s*")
LEADING_NUMBER = re.compile(rf"\s*({PLAIN_NUMBER})")
CSS_RULE, CSS_CLASS = r"([^{}]+)\{([^}]*)\}", r"\.([\w-]+)\s*(?:,|$)"
UNDRAWN = frozenset({"defs", "marker", "clipPath", "mask", "pattern", "symbol", "style"})
UNFILLED = ("none", "transparent")
TEXT_STYLE, ARROW_STYLE = frozenset({"style", "class", "font-family", "font-size", "text-anchor"}), frozenset({"style", "class", "marker-start", "marker-end"})
NAMESPACE = "http://www.w3.org/2000/svg "

Point = tuple[float, float]


def number(value: str | None, default: float = 0.0) -> float:
    """The number that a value begins with."""
    found = LEADING_NUMBER.match(value) if value else None
    try:
        return float(found[1]) if found else default
    except ValueError:  # dots alone
        return default


def pairs(value: str | None) -> list[Point]:
    numbers = list(map(number, re.findall(PLAIN_NUMBER, value or "")))
    return list(zip(numbers[::2], numbers[1::2]))


def instructions(path: str) -> Iterator[tuple[str, list[float]]]:
    """Commands with their arguments; a command that has more of them than it takes stands for several. Ends where the
    text makes no sense."""
    tokens = re.findall(PATH_TOKEN, path)
    at, command = 0, ""
    while at < len(tokens):
        given = tokens[at].isalpha()
        if given:
            command = tokens[at]
        takes = ARGUMENTS.get(command.upper())
        if takes is None or (not takes and not given):
            return
        at += given
        arguments = tokens[at : at + takes]
        if len(arguments) < takes or any(a.isalpha() for a in arguments):
            return
        at += takes
        yield command, list(map(float, arguments))
        command = {"M": "L", "m": "l"}.get(command, command)


def path_vertices(path: str) -> tuple[list[Point], list[bool]]:
    """The vertices of a path's first part, and whether each way between two of them is straight."""
    points: list[Point] = []
    straight: list[bool] = []
    x = y = 0.0
    for command, numbers in instructions(path):
        kind = command.upper()
        if kind == "M" and points:
            break
        base_x, base_y = (x, y) if command.islower() else (0.0, 0.0)
        if kind == "Z":
            if not points:
                continue
            x, y = points[0]
        else:
            x = x if kind == "V" else base_x + (numbers[0] if kind == "H" else numbers[-2])
            y = y if kind == "H" else base_y + numbers[-1]
        if points:
            straight.append(kind in "LHVZ")
        elif kind != "M":
            straight.append(kind in "LHV")
        points.append((x, y))
    return points, straight


def class_rules(sheets: list[str]) -> dict[str, dict[str, str]]:
    """Declarations by class name, later ones above earlier ones."""
    rules: dict[str, dict[str, str]] = {}
    for sheet in sheets:
        for selector, body in re.findall(CSS_RULE, sheet):
            declared = {k.strip(): v.strip() for k, _, v in (d.partition(":") for d in body.split(";")) if v.strip()}
            for name in re.findall(CSS_CLASS, selector.strip()):
                rules.setdefault(name, {}).update(declared)
    return rules


@cache
def declaration(key: str) -> re.Pattern:
    """A property's declaration in a style attribute."""
    return re.compile(rf"(?:^|;)\s*{key}\s*:\s*([^;]+)")


class Context(NamedTuple):
    """What an element passes on: its offset, and the style of text and arrows in it. ``silent``: nothing in it counts."""

    dx: float = 0.0
    dy: float = 0.0
    size: float = 16.0
    anchor: str = "start"
    mono: bool = False
    arrow: bool = False
    silent: bool = False


@dataclass
class Text:
    """A text element that is still open."""

    context: Context
    attributes: dict[str, str]
    depth: int
    lead: list[str] = field(default_factory=list)
    every: list[str] = field(default_factory=list)
    spans: list[tuple[dict[str, str], Context, list[str]]] = field(default_factory=list)
    children: int = 0


class Shapes:
    """Collects the shapes of one diagram as rows of ``operators.diagrams.SHAPE``."""

    def __init__(self, rules: dict[str, dict[str, str]]):
        self.rules, self.rows = rules, []
        self.stack, self.opened = [Context()], []
        self.text: Text | None = None

    def style(self, attributes: dict[str, str], key: str) -> str | None:
        """The element's own declaration, its last class that has one, or its attribute."""
        if "style" in attributes and (own := declaration(key).search(attributes["style"])):
            return own[1].strip()
        if "class" in attributes and (classes := [c for c in attributes["class"].split() if key in self.rules.get(c, ())]):
            return self.rules[classes[-1]][key]
        return attributes.get(key)

    def inside(self, attributes: dict[str, str], context: Context) -> Context:
        """The context with an element's style of text."""
        if TEXT_STYLE.isdisjoint(attributes):
            return context
        family = self.style(attributes, "font-family") or ""
        return context._replace(size=number(self.style(attributes, "font-size"), context.size), anchor=self.style(attributes, "text-anchor") or context.anchor, mono=context.mono or "mono" in family)

    def entered(self, tag: str, attributes: dict[str, str]) -> Context:
        context = self.stack[-1]
        if context.silent:
            return context
        moved = TRANSLATE.fullmatch(attributes["transform"]) if attributes.get("transform") else None
        if tag in UNDRAWN or (attributes.get("transform") and not moved):
            return context._replace(silent=True)
        if moved:
            context = context._replace(dx=context.dx + number(moved[1]), dy=context.dy + number(moved[2]))
        if not context.arrow and not ARROW_STYLE.isdisjoint(attributes) and (self.style(attributes, "marker-end") or self.style(attributes, "marker-start")):
            context = context._replace(arrow=True)
        return self.inside(attributes, context)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        tag = name.removeprefix(NAMESPACE)
        self.opened.append(tag)
        if len(self.stack) == 1:
            view = re.findall(PLAIN_NUMBER, attributes.get("viewBox", ""))
            if len(view) == 4:
                x, y, w, h = map(number, view)
                self.add("view", x0=x, y0=y, x1=x + w, y1=y + h)
        if self.text:  # its own lines come when it ends
            self.text.children += 1
            if tag == "tspan" and len(self.stack) == self.text.depth:
                self.text.spans.append((attributes, self.inside(attributes, self.text.context), []))
            self.stack.append(self.stack[-1])
            return
        context = self.entered(tag, attributes)
        self.stack.append(context)
        if not context.silent:
            if tag == "text":
                self.text = Text(context, attributes, len(self.stack))
            else:
                self.shape(tag, attributes, context)

    def characters(self, data: str) -> None:
        if t := self.text:
            t.every.append(data)
            if not t.children:
                t.lead.append(data)
            if self.opened[t.depth - 1 : t.depth] == ["tspan"]:
                t.spans[-1][2].append(data)

    def end(self, name: str) -> None:
        self.stack.pop()
        self.opened.pop()
        if self.text and len(self.stack) < self.text.depth:
            self.lines(self.text)
            self.text = None

    def add(self, kind: str, **columns: object) -> None:
        self.rows.append({"kind": kind, "n": len(self.rows)} | columns)

    def box(self, kind: str, context: Context, x0: float, y0: float, x1: float, y1: float) -> None:
        self.add(kind, x0=x0 + context.dx, y0=y0 + context.dy, x1=x1 + context.dx, y1=y1 + context.dy)

    def shape(self, tag: str, a: dict[str, str], context: Context) -> None:
        if tag == "rect":
            x, y, w, h = (number(a.get(k)) for k in ("x", "y", "width", "height"))
            if w > 0 and h > 0:
                self.box("rect", context, x, y, x + w, y + h)
        elif tag in ("circle", "ellipse"):
            cx, cy, rx, ry = number(a.get("cx")), number(a.get("cy")), number(a.get("r") or a.get("rx")), number(a.get("r") or a.get("ry"))
            self.box("ellipse", context, cx - rx, cy - ry, cx + rx, cy + ry)
        elif tag == "polygon" and (points := pairs(a.get("points"))):
            xs, ys = zip(*points)
            self.box("polygon", context, min(xs), min(ys), max(xs), max(ys))
        elif tag in ("line", "polyline", "path"):
            self.stroke(tag, a, context)

    def stroke(self, tag: str, a: dict[str, str], context: Context) -> None:
        if tag == "path":
            points, straight = path_vertices(a.get("d", ""))
        else:
            points = [(number(a.get(f"x{k}")), number(a.get(f"y{k}"))) for k in "12"] if tag == "line" else pairs(a.get("points"))
            straight = [True] * (len(points) - 1)
        if len(points) < 2 or (self.style(a, "fill") or ("black" if tag == "path" else "none")) not in UNFILLED:
            return
        begins, ends = bool(self.style(a, "marker-start")), bool(self.style(a, "marker-end"))
        self.add("stroke", points=[{"x": x + context.dx, "y": y + context.dy} for x, y in points], straight=straight, start=begins, end=ends or (context.arrow and not begins))

    def lines(self, text: Text) -> None:
        """The lines of a text element: one of all it says, or one for each placed span."""
        x, y = number(text.attributes.get("x")) + text.context.dx, number(text.attributes.get("y")) + text.context.dy
        found = [(x, y, text.context, "".join(text.every))]
        if any(a.get("x") or a.get("y") or a.get("dy") for a, _, _ in text.spans):
            found = [(x, y, text.context, "".join(text.lead))]
            for a, context, parts in text.spans:
                x = number(a["x"]) + context.dx if a.get("x") else x
                y = number(a["y"]) + context.dy if a.get("y") else y
                step = a.get("dy", "")
                y += number(step) * (context.size if "em" in step else 1)
                found.append((x, y, context, "".join(parts)))
        for x, y, context, said in found:
            if said := " ".join(said.split()):
                self.add("text", s=said, ax=x, ay=y, size=context.size, anchor=context.anchor, mono=context.mono)


def _parse(svg: str, start, end, characters) -> None:
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.Parse(svg, True)


def style_sheets(svg: str) -> list[str]:
    sheets: list[list[str]] = []
    opened: list[str] = []

    def start(name: str, _: dict[str, str]) -> None:
        opened.append(name.removeprefix(NAMESPACE))
        if opened[-1] == "style":
            sheets.append([])

    def characters(data: str) -> None:
        if opened[-1] == "style":
            sheets[-1].append(data)

    _parse(svg, start, lambda _: opened.pop(), characters)
    return ["".join(s) for s in sheets]


def shapes(svg: str | None) -> list[dict]:
    """The shapes of a diagram in drawing order. What is no well-formed markup has none; parts under a rotation, a scale or
    another transform than a shift have none either."""
    try:
        found = Shapes(class_rules(style_sheets(svg or "") if "style" in (svg or "") else []))
        _parse(svg or "", found.start, found.end, found.characters)
    except expat.ExpatError:
        return []
    return found.rows
