"""Trees that explain a plan, as text."""

from __future__ import annotations

from dataclasses import dataclass, field

_INLINE = 5


@dataclass
class TreeNode:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[tuple[str | None, TreeNode]] = field(default_factory=list)

    def attr(self, key: str, value: object) -> TreeNode:
        self.attrs[key] = str(value)
        return self

    def child(self, node: TreeNode, key: str | None = None) -> TreeNode:
        self.children.append((key, node))
        return self

    def _lines(self, key: str | None) -> list[str]:
        head = self.name if key is None else f"{key} = {self.name}"
        shown = [f"{k} = {v}" for k, v in self.attrs.items()]
        if not shown:
            lines = [head]
        elif len(shown) <= _INLINE:
            lines = [f"{head} ({', '.join(shown)})"]
        else:
            lines = [f"{head} (", *(f"    {s}," for s in shown[:-1]), f"    {shown[-1]}", ")"]
        return lines

    def __str__(self) -> str:
        out: list[str] = []

        def walk(node: TreeNode, key: str | None, first: str, rest: str) -> None:
            lines = node._lines(key)
            out.append(first + lines[0])
            out.extend(lines[1:])
            for n, (name, child) in enumerate(node.children):
                last = n == len(node.children) - 1
                walk(child, name, rest + ("└── " if last else "├── "), rest + ("    " if last else "│   "))

        walk(self, None, "", "")
        return "\n".join(out) + "\n"
