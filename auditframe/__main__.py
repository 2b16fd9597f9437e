from auditframe.cli import main

raise SystemExit(main())
