"""Where rows come from: message tables, logs and the shapes the test tables are read in."""
