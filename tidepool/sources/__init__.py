"""Where rows and images come from and go to."""
