"""Plan building blocks shared by the operators: staged tables and graph components."""
