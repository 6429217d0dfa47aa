"""A flowchart as SVG: nodes on a grid, arms side by side, labels escaped."""

from __future__ import annotations

from html import escape

from repoloom.render import flow
from repoloom.render.flow import Fact, Flow, Node

STEP, ACROSS, BOX_W, BOX_H, MARGIN = 90, 220, 180, 50, 60
_FILL = {"box": "#e3f2fd", "diamond": "#fff8e1", "round": "#e8f5e9"}


def empty(message: str = "No functions found") -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="100"><text x="320" y="55" text-anchor="middle">{escape(message)}</text></svg>'


def _node(node: Node, x: int, y: int) -> list[str]:
    fill = _FILL[node.shape]
    if node.shape == "diamond":
        out = [f'<polygon points="{x},{y - 35} {x + BOX_W // 2},{y} {x},{y + 35} {x - BOX_W // 2},{y}" fill="{fill}" stroke="#555"/>']
    else:
        out = [f'<rect x="{x - BOX_W // 2}" y="{y - BOX_H // 2}" width="{BOX_W}" height="{BOX_H}" rx="{25 if node.shape == "round" else 4}" fill="{fill}" stroke="#555"/>']
    return [*out, f'<text x="{x}" y="{y + 5}" text-anchor="middle" font-size="12">{escape(flow.short(node.label, 30))}</text>']


def draw(chart: Flow) -> str:
    """The nodes in rows and columns; arrows go from edge to edge, those back up and those past a row around the side."""
    columns = [n.column for n in chart.nodes]
    left, width = min(columns), (max(columns) - min(columns)) * ACROSS + BOX_W + 2 * MARGIN
    at = {n.id: (MARGIN + BOX_W // 2 + (n.column - left) * ACROSS, 50 + n.row * STEP, 35 if n.shape == "diamond" else BOX_H // 2) for n in chart.nodes}
    parts = []
    for a in chart.arrows:
        (x1, y1, h1), (x2, y2, h2) = at[a.source], at[a.target]
        if a.back or (x1 == x2 and y2 - y1 > STEP):
            side = x1 + (-1 if a.back else 1) * (BOX_W // 2 + 25)
            d = f"M{x1 + (-1 if a.back else 1) * BOX_W // 2},{y1} L{side},{y1} L{side},{y2} L{x2 + (-1 if a.back else 1) * BOX_W // 2},{y2}"
            lx, ly = side, (y1 + y2) // 2
        elif y1 == y2:
            way = 1 if x2 > x1 else -1
            d, lx, ly = f"M{x1 + way * BOX_W // 2},{y1} L{x2 - way * BOX_W // 2},{y2}", (x1 + x2) // 2, y1 - 6
        else:
            way = 1 if y2 > y1 else -1
            d, lx, ly = f"M{x1},{y1 + way * h1} L{x2},{y2 - way * h2}", (x1 + x2) // 2 + 4, (y1 + y2) // 2
        parts.append(f'<path d="{d}" fill="none" stroke="#333" marker-end="url(#arrow)"/>')
        if a.label:
            parts.append(f'<text x="{lx}" y="{ly}" font-size="11" class="arm">{escape(flow.short(a.label, 24))}</text>')
    for n in chart.nodes:
        parts += _node(n, *at[n.id][:2])
    height = 100 + max(n.row for n in chart.nodes) * STEP
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">'
    marker = '<defs><marker id="arrow" markerWidth="10" markerHeight="8" refX="8" refY="4" orient="auto"><path d="M0,0 L10,4 L0,8 z" fill="#333"/></marker></defs>'
    return "\n".join([head, marker, *parts, "</svg>"])


def flowchart(facts: list[Fact], function: str | None = None) -> str:
    main = flow.chosen(facts, function)
    return draw(flow.of_function(facts, main)) if main else empty()
