"""Sources and sinks: seeds, crawl logs, fetched pages, exports."""
