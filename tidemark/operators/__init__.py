"""DataFrame-level operators: as-of joins, keyed merges, ranks, exit scans."""
