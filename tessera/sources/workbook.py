"""Workbooks (Office Open XML) of small sheets, read and written on the driver without further libraries."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Fill colours of styled rows, in the order of their style numbers after plain (0) and header (1).
STYLES = {"good": "FFC6EFCE", "fair": "FFFFEB9C", "poor": "FFFFC7CE"}


def _letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(row: int, column: int, value: object, style: int) -> str:
    at = f'r="{_letters(column)}{row}" s="{style}"'
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
        return f"<c {at}><v>{value!r}</v></c>"
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))[:32_767]  # what a cell can hold
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(columns: list[str], rows: list[tuple]) -> str:
    shown = [c for c in columns if c != "style"]
    styled = columns.index("style") if "style" in columns else None
    numbers = {name: 2 + i for i, name in enumerate(STYLES)}
    lines = ["".join(_cell(1, k, c, 1) for k, c in enumerate(shown, 1))]
    for n, row in enumerate(rows, 2):
        style = 0 if styled is None else numbers.get(row[styled], 0)
        lines.append("".join(_cell(n, k, v, style) for k, v in enumerate((v for i, v in enumerate(row) if i != styled), 1)))
    body = "".join(f'<row r="{n}">{line}</row>' for n, line in enumerate(lines, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """The file of a workbook; each sheet is its columns and its rows. A column ``style`` names a row's fill and is not shown."""
    names = [re.sub(r"[\[\]:*?/\\]", " ", name)[:31] for name in sheets]
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in STYLES.values())
    styles = (
        f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts>'
        f'<fills count="{2 + len(STYLES)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(STYLES)}"><xf/><xf fontId="1" applyFont="1"/>'
        + "".join(f'<xf fillId="{2 + i}" applyFill="1"/>' for i in range(len(STYLES))) + "</cellXfs></styleSheet>"
    )
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>'
        + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">'
        + "".join(f'<Relationship Id="r{i}" Type="{_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        + f'<Relationship Id="s" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": styles,
    }
    parts |= {f"xl/worksheets/sheet{i}.xml": _sheet(*sheet) for i, sheet in enumerate(sheets.values(), 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def read_workbook(path: str) -> dict[str, tuple[list[str], list[list[str | None]]]]:
    """Every sheet's columns (its first row) and rows, each cell as text; empty cells are null, empty rows are left out."""
    with zipfile.ZipFile(path) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        texts = ["".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        out = {}
        for sheet in tree("xl/workbook.xml").iter(f"{{{_MAIN}}}sheet"):
            target = targets[sheet.get(f"{{{_RELS}}}id")].lstrip("/")
            rows = []
            for row in tree(target if target.startswith("xl/") else f"xl/{target}").iter(f"{{{_MAIN}}}row"):
                cells: dict[int, str] = {}
                for c in row:
                    column = 0
                    for letter in re.match("[A-Z]*", c.get("r", "")).group():
                        column = column * 26 + ord(letter) - 64
                    found = c.find(f"{{{_MAIN}}}v")
                    value = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")) if c.get("t") == "inlineStr" else None if found is None else found.text
                    if value is not None and c.get("t") == "s":
                        value = texts[int(value)]
                    if value not in (None, ""):
                        cells[(column or len(cells) + 1) - 1] = value
                if cells:
                    rows.append(cells)
            head = rows[0] if rows else {}
            width = max(head, default=-1) + 1
            out[sheet.get("name")] = ([head.get(k, f"column_{k}") for k in range(width)], [[r.get(k) for k in range(width)] for r in rows[1:]])
        return out
