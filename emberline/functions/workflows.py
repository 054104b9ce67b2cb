"""Steps of CI workflow files: the part of YAML that workflows use, read by a stack of indentations, as a column.

Maps, lists, plain, quoted and block scalars are read; flow collections stay text. Tabs, wrong indentation, lines
without a colon, unclosed quotes, anchors, aliases and tags make a file bad."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import compact_shell

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#&*!|>%@`\[\]{},?-](?:[^:#]|:(?=\S)|(?<!\s)#)*|[?-](?=\S)(?:[^:#]|:(?=\S)|(?<!\s)#)*)\s*:(?:\s+(.*))?$""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "/": "/", '"': '"', "\\": "\\", " ": " "}
STEPS = "bad boolean, steps array<struct<job_key:string,job:string,step:string,command:string>>"


def _scalar(text: str):
    """A plain or quoted scalar; words that mean nothing or a truth value are taken so."""
    if text[:1] in "\"'":
        end = re.match(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\']|\'\')*)\'', text)
        if not end or text[end.end() :].strip() and not text[end.end() :].lstrip().startswith("#"):
            raise ValueError("unclosed quote")
        if end[1] is not None:
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), end[1])
        return end[2].replace("''", "'")
    if text[:1] in ("&", "*", "!", "@", "`", "%"):
        raise ValueError("not in the subset")
    text = re.split(r"(?:^|\s)#", text)[0].strip()
    return {"": None, "~": None, "null": None, "true": True, "false": False, "yes": True, "no": False, "on": True, "off": False}.get(text.lower(), 0 if text == "0" else text)


def _block(lines: list[str], i: int, indent: int, header: str) -> tuple[str, int]:
    """A literal (|) or folded (>) scalar below column `indent`."""
    own, j = [], i
    while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip(" ")) > indent):
        own.append(lines[j])
        j += 1
    margin = min((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), default=0)
    own = [x[margin:] if x.strip() else "" for x in own]
    text = "\n".join(own).rstrip("\n")
    if header[0] == ">":
        text = re.sub(r"(?<!\n)\n(?![\n ])", " ", text)
    return (text if "-" in header else text + "\n" if text else ""), j


def _node(lines: list[str], i: int, indent: int) -> tuple[object, int]:
    """The map or list whose entries begin at column `indent`, from line i on, and the line after it."""
    out: dict | list | None = None
    while True:
        while i < len(lines) and (not lines[i].strip() or lines[i].lstrip().startswith("#")):
            i += 1
        if i == len(lines):
            return out, i
        line = lines[i]
        column = len(line) - len(line.lstrip(" "))
        if line[column] == "\t":
            raise ValueError("tab")
        if column < indent:
            return out, i
        if column > indent:
            raise ValueError("wrong indentation")
        body = line[column:].rstrip()
        if body == "-" or body.startswith("- "):
            if not isinstance(out, list | None):
                return out, i  # a list at the column of its key is the caller's
            out = [] if out is None else out
            inner = body[1:].lstrip()
            if not inner or inner.startswith("#"):
                value, i = _below(lines, i + 1, column)
            elif _KEY.match(inner) or inner.startswith("- "):
                at = column + len(body) - len(inner)
                lines[i] = " " * at + inner
                value, i = _node(lines, i, at)
            else:
                value, i = _value(lines, i + 1, column, inner)
            out.append(value)
            continue
        key = _KEY.match(body)
        if not key or isinstance(out, list):
            raise ValueError("a key is missing")
        out = {} if out is None else out
        rest = (key[2] or "").strip()
        if rest and not rest.startswith("#"):
            out[_scalar(key[1])], i = _value(lines, i + 1, column, rest)
        else:
            out[_scalar(key[1])], i = _below(lines, i + 1, column, True)


def _below(lines: list[str], i: int, column: int, key: bool = False) -> tuple[object, int]:
    """What is nested below a key or a dash, or nothing."""
    j = next((j for j in range(i, len(lines)) if lines[j].strip() and not lines[j].lstrip().startswith("#")), len(lines))
    if j == len(lines):
        return None, j
    at = len(lines[j]) - len(lines[j].lstrip(" "))
    if at > column or (key and at == column and re.match(r"-(\s|$)", lines[j][at:])):
        body = lines[j][at:].rstrip()
        if re.match(r"-(\s|$)", body) or _KEY.match(body):
            return _node(lines, j, at)
        return _value(lines, j + 1, column, body)
    return None, j


def _value(lines: list[str], i: int, column: int, text: str) -> tuple[object, int]:
    """A scalar that begins on the line before i and may go on below its key."""
    if re.match(r"[|>][+-]?\d?[+-]?\s*(#.*)?$", text):
        return _block(lines, i, column, text)
    while i < len(lines) and lines[i].strip() and len(lines[i]) - len(lines[i].lstrip(" ")) > column:
        if text[:1] not in "\"'[{" and _KEY.match(lines[i].strip()):
            raise ValueError("a map below a scalar")
        text, i = f"{text} {lines[i].strip()}", i + 1
    return _scalar(text), i


def steps_of(text: str | None) -> dict:
    """Whether a file is bad, and its steps with commands: jobs in order, steps in order."""
    try:
        lines = (text or "").replace("\r\n", "\n").split("\n")
        lines = [x for x in lines if x.strip() not in ("---", "...")]
        root, _ = _node(lines, 0, 0)
    except (ValueError, IndexError):
        return {"bad": True, "steps": []}
    jobs = (root.get("jobs") if isinstance(root, dict) else None) or {}
    out = []
    for key, job in jobs.items() if isinstance(jobs, dict) else ():
        for step in (job.get("steps") or [] if isinstance(job, dict) else []):
            if isinstance(step, dict) and step.get("run"):
                command = str(step["run"])
                out.append({"job_key": str(key), "job": str(job.get("name") or key), "step": str(step.get("name") or command).strip(), "command": command})
    return {"bad": root is not None and not isinstance(root, dict), "steps": out}


def workflow(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(steps_of, text)), columns=["bad", "steps"])


def command_candidates(files: DataFrame, path: str, text: str | Column) -> DataFrame:
    """(path, bad, place, command, source, job, step, text): a row for each step with a command, its command on one line; a file
    without any has one row without a place. Null and empty files have no steps and are not bad."""
    read_steps = F.pandas_udf(workflow, STEPS)
    read = files.select(F.col(path).alias("path"), read_steps(F.col(text) if isinstance(text, str) else text).alias("w"))
    each = read.select("path", "w.bad", F.posexplode_outer("w.steps").alias("place", "s"))
    return each.select("path", "bad", "place", compact_shell(F.col("s.command")).alias("command"), F.when(F.col("place").isNotNull(), F.concat(F.lit("workflow:"), "path")).alias("source"), "s.job", "s.step", F.concat_ws(" ", F.when(F.col("place").isNotNull(), F.col("s.job_key")), "s.job", "s.step").alias("text"))
