"""DataFrame operators: evidence matching, candidates, sub-items, tables, review, overlays."""
