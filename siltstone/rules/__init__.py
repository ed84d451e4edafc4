"""Rule packs (plain data) and how they are folded into plans."""
