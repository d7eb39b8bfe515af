"""Model manifests: a JSON document for what is small, tables beside it for what isn't; clusters and forests also as XML."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from tessera.operators.forest import Forest, Node, nodes_of

NS = "http://www.dmg.org/PMML-4_4"


@dataclass
class Manifest:
    """Kind, extensions by name (scalars or lists), and tables by name (paths)."""

    kind: str
    extensions: dict = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({"kind": self.kind, "extensions": self.extensions, "tables": self.tables}, separators=(",", ":"), sort_keys=True)

    @staticmethod
    def loads(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["kind"], d.get("extensions", {}), d.get("tables", {}))

    def extension(self, name: str, default=None):
        return self.extensions.get(name, default)


def redacted(config: dict, words: tuple[str, ...] = ("password", "secret", "token", "key")) -> dict:
    """A configuration that can be logged: values under telling names are masked."""
    return {k: redacted(v, words) if isinstance(v, dict) else "*****" if any(w in k.lower() for w in words) else v for k, v in config.items()}


def _root(kind: str) -> tuple[ET.Element, ET.Element]:
    top = ET.Element("PMML", {"xmlns": NS, "version": "4.4"})
    ET.SubElement(ET.SubElement(top, "Header"), "Application", {"name": "tessera"})
    return top, ET.SubElement(top, kind)


def clusters_xml(clusters: list[tuple[int, list[float], int]]) -> str:
    top, model = _root("ClusteringModel")
    model.set("numberOfClusters", str(len(clusters)))
    for i, center, count in clusters:
        c = ET.SubElement(model, "Cluster", {"id": str(i), "size": str(count)})
        ET.SubElement(c, "Array", {"type": "real", "n": str(len(center))}).text = " ".join(map(repr, center))
    return ET.tostring(top, encoding="unicode")


def clusters_from_xml(text: str) -> list[tuple[int, list[float], int]]:
    found = ET.fromstring(text).iter(f"{{{NS}}}Cluster")
    return [(int(c.get("id")), [float(v) for v in c.find(f"{{{NS}}}Array").text.split()], int(c.get("size", "0"))) for c in found]


def forest_xml(forest: Forest) -> str:
    top, model = _root("MiningModel")
    for tree, weight in zip(forest.trees, forest.weights, strict=True):
        segment = ET.SubElement(model, "Segment", {"weight": repr(weight)})
        for n in nodes_of(tree):
            ET.SubElement(segment, "Node", {"id": n.path, "value": json.dumps({k: v for k, v in vars(n).items() if k not in ("positive", "negative", "path") and v is not None})})
    ET.SubElement(model, "Importances").text = " ".join(map(repr, forest.importances))
    return ET.tostring(top, encoding="unicode")


def forest_from_xml(text: str) -> Forest:
    top = ET.fromstring(text)
    trees, weights = [], []
    for segment in top.iter(f"{{{NS}}}Segment"):
        by = {x.get("id"): Node(x.get("id"), **json.loads(x.get("value"))) for x in segment.iter(f"{{{NS}}}Node")}
        for path, node in by.items():
            if path != "r":
                setattr(by[path[:-1]], "positive" if path[-1] == "+" else "negative", node)
        trees.append(by["r"])
        weights.append(float(segment.get("weight")))
    values = (top.find(f".//{{{NS}}}Importances").text or "").split()
    return Forest(trees, weights, [float(v) for v in values])
