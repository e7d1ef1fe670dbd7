"""The write rules in plain Python: pointers and one list a column."""

from tidelog.model import BLOB, DELETE, FAMILIES


class Model:
    def __init__(self):
        self.pointers: dict[int, dict[str, int]] = {}
        self.columns: dict[tuple[str, str], list] = {}

    def apply(self, op, entity, strs, ints, blobs):
        new = {}
        for family, attrs in zip(("str", "int", "blob"), (strs, ints, blobs)):
            for name, v in attrs.items():
                column = self.columns.setdefault((name, family), [])
                new[name] = len(column)
                column.append(v)
        self.pointers[entity] = {} if op == DELETE else new

    def get(self, entity, attr, family):
        at = self.pointers.get(entity, {}).get(attr)
        return None if at is None or (attr, family) not in self.columns else self.columns[(attr, family)][at]

    def range(self, entity, attr, length):
        at = self.pointers.get(entity, {}).get(attr)
        return None if at is None else self.columns[(attr, "int")][at : at + length]


__all__ = ["BLOB", "FAMILIES", "Model"]
