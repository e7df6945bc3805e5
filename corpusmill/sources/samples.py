"""Made-up input for trying the engine out: a corpus of Markdown documents, files with a table each, and a check of what is installed."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from .pdf import EXTRACTORS, minimal_pdf

TOPICS = ("apprenticeships", "teacher training", "digital skills", "green jobs", "quality assurance", "career guidance", "recognition of learning", "rural access")


def corpus() -> dict[str, str]:
    """Eight documents: headings, text before the first one, a long section, a pipe table, personal data, and an empty document."""
    found = {}
    for i, topic in enumerate(TOPICS):
        long_part = " ".join(f"Measure {k} on {topic} sets out who acts and by when." for k in range(1, 4 + 20 * (i == 2)))
        table = "\n".join(["| Year | Places |", "|---|---|", *(f"| {2020 + k} | {1000 * (i + 1) + k} |" for k in range(3))])
        found[f"{i + 1:02d}_{topic.replace(' ', '_')}.md"] = f"Note {i}.\n\n# On {topic}\n\n## Aim\n{long_part}\n\n## Numbers\n{table}\n\n## Contact\nMs Ada Example{i}, ada{i}@example.org, +41 22 555 01 0{i}\n"
    found["09_empty.md"] = ""
    return found


def write_corpus(folder: str) -> list[str]:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, body in corpus().items():
        (Path(folder) / name).write_text(body, encoding="utf-8")
    return sorted(corpus())


def write_pdfs(folder: str) -> list[str]:
    """Three one-page PDFs with a table of four rows."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for i, topic in enumerate(TOPICS[:3]):
        lines = [f"Report on {topic}", "| Region | Places |", "|---|---|", *(f"| R{k} | {100 * (i + 1) + k} |" for k in range(4))]
        names.append(f"report_{i + 1}.pdf")
        (Path(folder) / names[-1]).write_bytes(minimal_pdf(lines))
    return names


def preflight(folders: list[str], agents: list[dict], ready: dict[str, bool]) -> list[tuple[str, str, bool]]:
    """(check, subject, ok): optional packages, folders, and each pair of backend and model that agents ask for, once. ready says which models a
    backend has; a name without a tag also means its latest."""
    rows = [("package", n, importlib.util.find_spec(n) is not None) for n in EXTRACTORS if n not in ("own", "pdftotext")]
    rows += [("folder", f, Path(f).is_dir()) for f in folders]
    pairs = dict.fromkeys((a.get("backend", "mock"), a.get("model", "")) for a in agents)
    rows += [("model", f"{b}:{m}", b == "mock" or ready.get(m, ready.get(f"{m}:latest", False))) for b, m in pairs]
    return rows
