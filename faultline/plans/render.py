"""HTML of small marts, and notifiers that write instead of sending. Every value is escaped."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame

#: Rows that a report shows of one mart at most: marts are aggregates, this guards against a wrong one.
SHOWN = 10_000


class Notifier(Protocol):
    def send(self, title: str, body: str) -> None: ...


class FileNotifier:
    """SNK08's default: a message is a JSON file in the driver's report folder."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def send(self, title: str, body: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{len(list(self.folder.glob('*.json'))):05d}.json").write_text(json.dumps({"title": title, "body": body}))


def cell(value: object) -> str:
    """SC34: lists become bullet lists."""
    if isinstance(value, list | tuple):
        return "<ul>" + "".join(f"<li>{cell(v)}</li>" for v in value) + "</ul>"
    if isinstance(value, int) and not isinstance(value, bool):
        return f"{value:,}"
    return html.escape("" if value is None else str(value))


def table(mart: DataFrame, title: str) -> str:
    rows = mart.limit(SHOWN).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in mart.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>"


def change_list(changes: DataFrame) -> str:
    """RP08: changes (repository, url, message) as a list of lists; a change without an address is plain text, and none
    at all is a dash."""
    out: dict[str, list[str]] = {}
    for r in changes.limit(SHOWN).collect():
        text = html.escape(r["message"] or r["url"] or "")
        out.setdefault(r["repository"] or "", []).append(f"<li><a href='{html.escape(r['url'], quote=True)}'>{text}</a></li>" if r["url"] else f"<li>{text}</li>")
    return "<ul>" + "".join(f"<li><b>{html.escape(k)}</b><ul>{''.join(v)}</ul></li>" for k, v in out.items()) + "</ul>" if out else "-"


def bars(pairs: Iterable[tuple[str, int]]) -> str:
    """SC35: widths in percent of the largest; nothing for no pairs."""
    pairs = list(pairs)
    top = max((n for _, n in pairs), default=0)
    return "".join(f"<div class='bar' style='width:{100 * n / top if top else 0:.1f}%'>{html.escape(k)}: {n:,}</div>" for k, n in pairs)


def page(title: str, sections: Iterable[str]) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(sections)}</body></html>"
