"""Tables in and out: tab-separated sources, partitioned stores, audits, match-list sinks."""
