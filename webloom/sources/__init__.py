"""Where pages come from: URL templates, character sets, policies, fetching."""
