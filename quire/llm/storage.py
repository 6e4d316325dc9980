"""Tables that cut lineage; see ``quire.storage``."""

from quire.storage import created, drop_since, drop_table, let_go, materialize, new_path, shared_root

__all__ = ["created", "drop_since", "drop_table", "let_go", "materialize", "new_path", "shared_root"]
