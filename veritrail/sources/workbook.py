"""Sheets as an Office Open XML workbook, written row by row with the standard library."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from ..operators import report

# Names of the sheets and heads of their columns.
SHEETS = {"all": "全部表述", "confirmed": "已确认", "pending": "待确认", "warned": "反向验证", "coverage": "实体覆盖"}
HEADS = {
    "target_path": "目标文档", "claim_id": "序号", "kind": "类型", "claim_text": "表述内容", "status": "状态", "source": "出处", "snippet": "原文片段", "codes": "反向验证警告",
    "numbers": "命中数字", "matched_keyword": "匹配关键词", "advice": "建议", "names": "实体", "note": "实体覆盖",
}
WIDTHS = {"claim_id": 8, "kind": 8, "status": 14, "claim_text": 60, "snippet": 60}
#: Rows that a sheet holds by the format; more go to a further sheet.
MOST_ROWS = 1_048_576
_NS = "http://schemas.openxmlformats.org"
# style 1: head; 2 to 5: by the mark in the status
_COLOURS = ("FFD9E1F2", "FFC6EFCE", "FFFFEB9C", "FFFFC7CE", "FFFFFFFF")
_STYLE = {"✓": 2, "△": 3, "✗": 4}


def _cell(value: object, style: int) -> str:
    text = "" if value is None else re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]", "", str(value))[:32767]
    return f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _rows(columns: list[str], rows: Iterable) -> Iterator[str]:
    yield "<row>" + "".join(_cell(HEADS.get(c, c), 1) for c in columns) + "</row>"
    for r in rows:
        status = r["status"] if "status" in columns else ""
        style = next((s for mark, s in _STYLE.items() if mark in (status or "")), 5)
        yield "<row>" + "".join(_cell(r[c], style if c == "status" else 5) for c in columns) + "</row>"


def write_workbook(claims: DataFrame, path: str) -> None:
    """The five sheets of the claims of one report. Rows come to the driver one at a time."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names: list[str] = []
        for key, df in report.sheets(claims).items():
            rows = df.orderBy("claim_id").toLocalIterator()
            part = list(islice(rows, 1))
            first = True
            while part or first:
                names.append(SHEETS[key] + ("" if first else f" {len(names) + 1}"))
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                    widths = "".join(f'<col min="{n}" max="{n}" width="{WIDTHS.get(c, 20)}" customWidth="1"/>' for n, c in enumerate(df.columns, 1))
                    f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS}/spreadsheetml/2006/main"><cols>{widths}</cols><sheetData>'.encode())
                    for row in _rows(df.columns, (r for some in (part, islice(rows, MOST_ROWS - 2)) for r in some)):
                        f.write(row.encode())
                    f.write(b"</sheetData></worksheet>")
                first, part = False, list(islice(rows, 1))
        fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in _COLOURS)
        styles = "".join(f'<xf fontId="{int(n == 0)}" fillId="{n + 2}" borderId="0" applyFill="1" applyFont="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf>' for n in range(len(_COLOURS)))
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{_NS}/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(_COLOURS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(_COLOURS) + 1}"><xf/>{styles}</cellXfs></styleSheet>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NS}/package/2006/relationships">{links}<Relationship Id="rId0" Type="{_NS}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
