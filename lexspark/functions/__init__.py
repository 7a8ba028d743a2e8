"""Column functions: words, URLs, HTML, text analysis."""
