"""Where rows come from and go to: fixtures and the versioned store."""
