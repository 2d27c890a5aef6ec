"""Where rows come from: file names, schemas, readers."""
