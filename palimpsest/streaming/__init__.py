"""Change logs as streams: keeping a layer up to date, and counting changes over windows of time."""
