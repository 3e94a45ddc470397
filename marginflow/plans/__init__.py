"""How operators are put together: checked broadcasts and the whole report."""
