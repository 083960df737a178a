"""Configuration from JSON or XML text: dotted paths, a flat map, JSON round trips."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

from lexmill.errors import InvalidFormat, NotFound


def _from_xml(node: ET.Element) -> Any:
    children = list(node)
    if not children and not node.attrib:
        return (node.text or "").strip()
    out: dict[str, Any] = dict(node.attrib)
    for child in children:
        value = _from_xml(child)
        if child.tag in out:
            held = out[child.tag]
            out[child.tag] = [*held, value] if isinstance(held, list) else [held, value]
        else:
            out[child.tag] = value
    return out


class Config:
    """A tree of settings; paths are dotted, array elements by number."""

    def __init__(self, tree: dict[str, Any] | None = None):
        self.tree = tree if tree is not None else {}

    @classmethod
    def parse(cls, text: str) -> Config:
        """Read JSON, or XML where the text starts with ``<``; the XML root's name is the first part of every path."""
        if text.lstrip().startswith("<"):
            try:
                root = ET.fromstring(text)
            except ET.ParseError as e:
                raise InvalidFormat(f"bad XML: {e}") from None
            return cls({root.tag: _from_xml(root)})
        try:
            tree = json.loads(text)
        except ValueError as e:
            raise InvalidFormat(f"bad JSON: {e}") from None
        if not isinstance(tree, dict):
            raise InvalidFormat("the root must be an object")
        return cls(tree)

    @classmethod
    def read(cls, spark, path: str) -> Config:
        """Read a file through Spark, so that any store it knows will do."""
        return cls.parse("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))

    def get(self, path: str, *default: Any) -> Any:
        node: Any = self.tree
        for part in path.split("."):
            if isinstance(node, dict) and part in node:
                node = node[part]
            elif isinstance(node, list) and part.isdigit() and int(part) < len(node):
                node = node[int(part)]
            elif default:
                return default[0]
            else:
                raise NotFound(f"no setting {path}")
        return node

    def put(self, path: str, value: Any) -> None:
        *parents, last = path.split(".")
        node = self.tree
        for part in parents:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise InvalidFormat(f"{part} in {path} is not an object")
        node[last] = value

    def flat(self) -> dict[str, Any]:
        """Leaf path -> value."""

        def walk(node: Any, path: str) -> Iterator[tuple[str, Any]]:
            items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else None
            if items is None:
                yield path, node
            else:
                for k, v in items:
                    yield from walk(v, f"{path}.{k}" if path else str(k))

        return dict(walk(self.tree, ""))

    def dump(self) -> str:
        return json.dumps(self.tree, ensure_ascii=False, sort_keys=True)
