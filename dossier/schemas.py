"""Columns of the tables that are exchanged as files."""

REQUESTS = "item string, prompt string, part bigint, paths array<string>, n_files int, total_bytes bigint"
