"""DataFrame transformations: cells, alignment, rates, gaps, reports."""
